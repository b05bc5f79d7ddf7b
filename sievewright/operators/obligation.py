"""Obligation strength of passages, and how a claim's compares with its source's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists


def _folded(passage: Column) -> Column:
    """Lower case, with the letters that the patterns' Unicode case takes for s, i and k."""
    return F.lower(F.translate(passage, "\u017f\u0131\u0130\u212a", "siik"))


def forces(passage: Column) -> Column:
    """Array of the forces present, strongest first; prohibitions are cut out before the rest is looked for.

    A pattern is only searched for in texts that hold one of its stems, which is far cheaper to see.
    """
    def may_hold(folded: Column, force: str) -> Column:
        hit = F.lit(False)
        for stem in reversed(lists.FORCE_STEMS[force]):
            hit = folded.contains(stem) | hit
        return hit

    def found(p: Column, folded: Column, force: str) -> Column:
        return F.when(may_hold(folded, force) & p.rlike(lists.FORCES[force]), force)

    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def rest(x: Column) -> Column:
        cut = F.when(x["first"].isNull(), x["p"]).otherwise(F.regexp_replace(x["p"], lists.FORCES["prohibitive"], " "))
        again = lambda y: F.array_compact(F.array(x["first"], *(found(y["p"], y["f"], f) for f in lists.FORCE_ORDER[1:4])))
        return let(cut, lambda c: let(F.struct(c.alias("p"), F.when(x["first"].isNull(), x["f"]).otherwise(_folded(c)).alias("f")), again))

    first = lambda x: F.struct(x["p"].alias("p"), x["f"].alias("f"), found(x["p"], x["f"], "prohibitive").alias("first"))
    present = let(let(F.struct(passage.alias("p"), _folded(passage).alias("f")), first), rest)
    return let(present, lambda all_: F.when(F.size(all_) == 0, F.array(F.lit("none"))).otherwise(all_))


def strongest(passage: Column) -> Column:
    return F.element_at(forces(passage), 1)


def drift_of(claim: Column, source: Column) -> Column:
    """preserved, strengthened, weakened, or no_force where the claim states none; both are arrays of forces.

    Make the arrays columns of their own first: then each text is searched once.
    """
    order = F.array(*map(F.lit, lists.FORCE_ORDER))
    stated = F.element_at(claim, 1)
    stronger = F.array_position(order, stated) < F.array_position(order, F.element_at(source, 1))
    return F.when(stated == "none", "no_force").when(F.array_contains(source, stated), "preserved").when(stronger, "strengthened").otherwise("weakened")


def drift(claim: Column, source: Column) -> Column:
    """drift_of for two texts."""
    return drift_of(forces(claim), forces(source))


def fidelity(pairs: DataFrame) -> DataFrame:
    """pairs (claim, source), blank ones left out -> counts of each drift and the preserved share of those with a force (1 if none)."""
    kept = pairs.where("trim(claim) <> '' and trim(source) <> ''").select(forces(F.col("claim")).alias("c"), forces(F.col("source")).alias("s")).select(drift_of(F.col("c"), F.col("s")).alias("d"))
    count = {k: F.count_if(F.col("d") == k) for k in ("preserved", "strengthened", "weakened", "no_force")}
    forced = count["preserved"] + count["strengthened"] + count["weakened"]
    return kept.agg(*(c.alias(k) for k, c in count.items()), F.when(forced == 0, 1.0).otherwise(count["preserved"] / forced).alias("fidelity"))

"""Connected components of pairs, and the entity merges that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.graph import merged_entities, similar_names
from folioscope.session import written


def components(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """(id, component): each id of a pair with the smallest id that pairs connect it to, by randomised contraction.

    In a round every id takes as its parent the id of the smallest hash among itself and its partners, with other hashes each
    round; then ids are replaced by their parents, and pairs that became loops or repetitions go. What is left are the ids that somebody took, an
    expected share below 3/4 of those before, so a path of n ids takes a number of rounds that grows with the logarithm of n,
    and the tables of all rounds together are a few times the first. The parents are joined to each other from the last round
    back. An id with many partners is a group that is combined before the shuffle, and a skewed join that Spark splits.

    Null ids and pairs of an id with itself connect nothing; ids that only occur in such pairs get no row.
    """
    low, high = F.least(first, second), F.greatest(first, second)
    edges = written(pairs.where(F.col(first).isNotNull() & F.col(second).isNotNull() & (F.col(first) != F.col(second))).select(low.alias("a"), high.alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        number = F.lit(len(rounds))
        ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))))
        ranked = F.struct(F.xxhash64("other", number).alias("h"), F.col("other").alias("id"))
        own = F.struct(F.xxhash64("id", number).alias("h"), F.col("id"))
        parents = written(ends.groupBy("id").agg(F.min(ranked).alias("best")).select("id", F.least("best", own)["id"].alias("parent")))
        rounds.append(parents)
        of_a, of_b = parents.select(F.col("id").alias("a"), F.col("parent").alias("pa")), parents.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(of_a, "a").join(of_b, "b").where("pa <> pb")
        edges = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = rounds.pop()
    while rounds:
        above = found.select(F.col("id").alias("parent"), F.col("parent").alias("top"))
        found = rounds.pop().join(above, "parent", "left").select("id", F.coalesce("top", "parent").alias("parent"))
    found = written(found)
    smallest = found.groupBy("parent").agg(F.min("id").alias("component"))
    return found.join(smallest, "parent").select("id", "component")


def merge_pairs(entities: DataFrame, *, layer: str, least: float) -> DataFrame:
    """(first_id, second_id) that tie together all entities of one layer with equal or similar names.

    Entities of one name are tied to the smallest of them, one pair each; names are compared once, whatever the number of
    entities that bear them. So the pairs grow with the entities and with pairs of similar names, not with the square of a frequent name.
    """
    named = entities.select("entity_id", F.col(layer).alias("layer"), F.trim("name").alias("name")).where("name <> ''")
    firsts = named.groupBy("layer", "name").agg(F.min("entity_id").alias("first_id"))
    equal = named.join(firsts, ["layer", "name"]).where("entity_id <> first_id").select("first_id", F.col("entity_id").alias("second_id"))
    alike = similar_names(firsts.select(F.col("first_id").alias("entity_id"), "layer", "name"), layer="layer", least=least, auto=least)
    return equal.unionByName(alike.select("first_id", "second_id"))


def merged_by_name(entities: DataFrame, edges: DataFrame, *, layer: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Entities (entity_id, name, aliases, ...) and edges after all entities whose names are linked by similarity are merged into the smallest id."""
    grouped = components(merge_pairs(entities, layer=layer, least=least), "first_id", "second_id")
    return merged_entities(entities, edges, grouped.where("id <> component").select(F.col("id").alias("loser"), F.col("component").alias("keeper")))

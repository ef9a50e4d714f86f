"""Entity graphs and trees: endpoints, checks, neighbourhoods, merges, subtrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import similarity
from folioscope.session import written

SUBJECT, OBJECT = "source_id", "target_id"
#: Relations that a task sums up, about, and over how many tasks those of one pair of ends are dealt.
TASK_RELATIONS, SHARES = 500_000, 16


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct ids at either end: one pass over the edges instead of a join on either column."""
    return edges.select(F.explode(F.array(SUBJECT, OBJECT)).alias("entity_id")).where("entity_id IS NOT NULL").distinct()


def orphans(entities: DataFrame, edges: DataFrame, *, before: Column | None = None, since: str | None = None) -> DataFrame:
    """Entities without an edge, created before a date if one is given."""
    out = entities.join(endpoints(edges), "entity_id", "left_anti")
    return out if before is None or since is None else out.where(F.col(since) < before)


def contradictions(relations: DataFrame) -> DataFrame:
    """Pairs of relations between the same entities, of different types, from different documents.

    relations: relation_id, source_id, target_id, relation_type, doc_id. The pairs are what is asked for, so
    their number is that of the answer: only entities with relations of two types from two documents are joined, on both ends.
    """
    ends = [SUBJECT, OBJECT]
    mixed = relations.groupBy(*ends).agg(F.min("relation_type").alias("t0"), F.max("relation_type").alias("t1"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("t0 <> t1 AND d0 <> d1")
    rows = relations.join(mixed.select(*ends), ends, "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.source_id") == F.col("b.source_id")) & (F.col("a.target_id") == F.col("b.target_id"))
    pairs = a.join(b, same & (F.col("a.relation_id") < F.col("b.relation_id")) & (F.col("a.doc_id") != F.col("b.doc_id")) & (F.col("a.relation_type") != F.col("b.relation_type")))
    return pairs.select(F.col("a.relation_id").alias("first_id"), F.col("b.relation_id").alias("second_id"), F.col("a.source_id").alias("source_id"), F.col("a.target_id").alias("target_id"), F.col("a.relation_type").alias("first_type"), F.col("b.relation_type").alias("second_type"))


def contradiction_groups(relations: DataFrame, *, task_rows: int = TASK_RELATIONS) -> DataFrame:
    """(source_id, target_id, n_pairs, relations, documents, types): the ends with contradictions, how many pairs of relations contradict
    each other, and the relations and documents of each type, as a sorted array of (relation_type, n, n_docs).

    The pairs are counted from sums over types and documents, none is made: all pairs, less those of one document, less those of one
    type, and those of both again. So one pair of ends with very many relations costs what its rows cost. Null types and documents contradict nothing, null ends are no ends.

    Ends are nearly as many as relations, so combining before a shuffle saves nothing and fills the memory of a task with what it read. The relations
    are dealt first, about `task_rows` to a task however many there are, those of one pair of ends over SHARES tasks by their document;
    all sums of a share are made where it lies, and a pair's sums, at most SHARES for each type, meet in a second deal.
    """
    ends = [SUBJECT, OBJECT]
    told = relations.select(*ends, "relation_type", "doc_id").dropna()
    tasks = max(int(relations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-told.count() // task_rows))
    share = [*ends, "_share"]
    dealt = told.withColumn("_share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("int")).repartition(tasks, *share)
    square = (F.col("n") * F.col("n")).cast("decimal(38,0)")
    cells = dealt.groupBy(*share, "relation_type", "doc_id").agg(F.count("*").alias("n"))
    types = cells.groupBy(*share, "relation_type").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"), F.sum(square).alias("both")).drop("_share")
    docs = dealt.groupBy(*share, "doc_id").agg(F.count("*").alias("n")).groupBy(*share).agg(F.sum(square).alias("of_docs"), F.count("*").alias("documents")).drop("_share")
    met = types.unionByName(docs, allowMissingColumns=True).repartition(tasks, *ends)  # the sums over documents have no type
    sums = met.groupBy(*ends, "relation_type").agg(*(F.sum(c).alias(c) for c in ("n", "n_docs", "both", "of_docs", "documents")))
    listed = F.collect_list(F.when(F.col("relation_type").isNotNull(), F.struct("relation_type", "n", "n_docs")))
    whole = sums.groupBy(*ends).agg(F.sum("n").alias("n"), F.sum(square).alias("of_types"), F.sum("both").alias("both"), F.sum("of_docs").alias("of_docs"), F.sum("documents").alias("documents"), F.sort_array(listed).alias("types"))
    pairs = ((square - F.col("of_docs") - F.col("of_types") + F.col("both")) / 2).cast("long")
    return whole.select(*ends, pairs.alias("n_pairs"), F.col("n").alias("relations"), "documents", "types").where("n_pairs > 0")


def near_names(names: DataFrame, *, least: float) -> DataFrame:
    """(layer, long_name, short_name, confidence): pairs of different names of a layer with at most a share of edits, each once.

    Rows are (layer, name) or (layer, name, side): with a boolean side only names of differing sides pair. Names within k
    edits share one of k + 1 pieces. So that no pair is compared without cause, the longer name of a pair is cut into pieces, and the shorter offers,
    for each length that a longer one has, the substrings that a piece may equal. Of the pieces one is equal such that up to i edits are before
    piece i and up to k - i behind it, which bounds how far it is shifted, counted from either end.
    """
    sided = "side" in names.columns
    names = names.where("name <> ''").select("layer", "name", (F.col("side") if sided else F.lit(True)).alias("side")).distinct().withColumn("n", F.char_length("name"))
    k = F.floor((1 - least) * F.col("longest") + 1e-9).cast("int")
    at = lambda i: i * F.floor(F.col("longest") / (F.col("k") + 1)).cast("int")
    size = lambda i: F.when(i == F.col("k"), F.col("longest") - at(i)).otherwise(at(i + 1) - at(i))
    pieces = F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i")
    cut = names.withColumn("longest", F.col("n")).withColumn("k", k).select("*", pieces).where(size(F.col("i")) > 0)
    cut = cut.select("layer", F.col("side").alias("meets"), "longest", "i", F.substring("name", at(F.col("i")) + 1, size(F.col("i"))).alias("bit"), F.col("name").alias("long_name"))
    # Lengths are few, whatever the names: the table of them is as small as the longest name is long.
    lengths = names.select(F.col("side").alias("meets"), F.col("n").alias("longest")).distinct()
    offered = names.withColumn("meets", ~F.col("side") if sided else F.col("side"))
    offered = offered.join(F.broadcast(lengths.withColumnRenamed("meets", "_meets")), (F.col("meets") == F.col("_meets")) & F.col("longest").between(F.col("n"), F.floor(F.col("n") / least + 1e-9))).drop("_meets")
    if sided:  # of two equally long names the one of the true side is cut
        offered = offered.where((F.col("longest") > F.col("n")) | F.col("meets"))
    offered = offered.withColumn("k", k).select("*", pieces).where(size(F.col("i")) > 0)
    i, shorter = F.col("i"), F.col("n") - F.col("longest")
    low, high = F.greatest(-i, shorter - (F.col("k") - i), -at(i)), F.least(i, shorter + (F.col("k") - i), F.col("n") - at(i) - size(i))
    offered = offered.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("shift", F.explode(F.sequence("low", "high")))
    bit = F.substring("name", at(i) + F.col("shift") + 1, size(i))
    offered = offered.select("layer", "meets", "longest", "i", bit.alias("bit"), F.col("name").alias("short_name"), "n")
    met = cut.join(offered, ["layer", "meets", "longest", "i", "bit"])
    met = met.where((F.col("n") < F.col("longest")) | (F.col("long_name") != F.col("short_name") if sided else F.col("long_name") > F.col("short_name")))
    near = met.withColumn("confidence", similarity(F.col("long_name"), F.col("short_name"))).where(F.col("confidence") >= least)
    return near.select("layer", "long_name", "short_name", "confidence").distinct()


def similar_names(entities: DataFrame, *, layer: str, least: float, auto: float) -> DataFrame:
    """Pairs of entities of one layer with similar names: first_id, second_id, confidence, canonical, action.

    Different names are compared once, however many entities have them (`near_names`); the pairs of entities follow by two joins.
    """
    rows = entities.select("entity_id", F.col(layer).alias("layer"), F.trim("name").alias("name")).where("name <> '' AND layer IS NOT NULL").distinct()
    names = rows.select("layer", "name").distinct()
    pairs = near_names(names, least=least).unionByName(names.select("layer", F.col("name").alias("long_name"), F.col("name").alias("short_name"), F.lit(1.0).alias("confidence")))
    for side in ("long", "short"):
        pairs = pairs.join(rows.select("layer", F.col("name").alias(f"{side}_name"), F.col("entity_id").alias(f"{side}_id")), ["layer", f"{side}_name"])
    swapped = F.col("long_id") > F.col("short_id")
    pairs = pairs.where(F.when(F.col("long_name") == F.col("short_name"), ~swapped & (F.col("long_id") != F.col("short_id"))).otherwise(F.col("long_id") != F.col("short_id")))
    # The longer name, and of two equally long ones that of the first entity.
    canonical = F.when(swapped & (F.char_length("short_name") == F.char_length("long_name")), F.col("short_name")).otherwise(F.col("long_name"))
    return pairs.select("layer", F.least("long_id", "short_id").alias("first_id"), F.greatest("long_id", "short_id").alias("second_id"), "confidence", canonical.alias("canonical"), F.when(F.col("confidence") >= auto, "auto_merge").otherwise("review").alias("action"))


def edge_stats(edges: DataFrame) -> DataFrame:
    """Edges and distinct ends by type, and over all."""
    sides = F.explode(F.array(SUBJECT, OBJECT))
    rows = edges.select(F.explode(F.array(F.col("relation_type"), F.lit("all"))).alias("relation_type"), SUBJECT, OBJECT)
    counts = rows.groupBy("relation_type").agg(F.count("*").alias("edges"))
    ends = rows.select("relation_type", sides.alias("id")).groupBy("relation_type").agg(F.countDistinct("id").alias("entities"))
    return counts.join(ends, "relation_type")


def relations_by_document(edges: DataFrame) -> DataFrame:
    """(doc_id, relation_type, n)."""
    return edges.groupBy("doc_id", "relation_type").agg(F.count("*").alias("n"))


def around(edges: DataFrame, entity: str) -> DataFrame:
    """Edges of an entity with their direction and the other end."""
    out = edges.where(F.col(SUBJECT) == entity).select(F.lit("out").alias("direction"), F.col(OBJECT).alias("other_id"), "relation_type")
    return out.unionByName(edges.where(F.col(OBJECT) == entity).select(F.lit("in").alias("direction"), F.col(SUBJECT).alias("other_id"), "relation_type"))


def snapshot(edges: DataFrame, entities: DataFrame, *, without: Sequence[str] = ()) -> DataFrame:
    """Edges both ends of which exist, of all types but those left out."""
    ids = entities.select("entity_id")
    kept = edges.where(~F.col("relation_type").isin(*without)) if without else edges
    return kept.join(ids.withColumnRenamed("entity_id", SUBJECT), SUBJECT, "left_semi").join(ids.withColumnRenamed("entity_id", OBJECT), OBJECT, "left_semi").select(*edges.columns)


def upsert_entities(rows: DataFrame) -> DataFrame:
    """One entity per (name, library): first id and creation, latest description, all aliases."""
    return rows.groupBy("name", "library_id").agg(
        F.min_by("entity_id", F.struct("created_at", "entity_id")).alias("entity_id"),
        F.min("created_at").alias("created_at"),
        F.max_by("description", F.struct("created_at", "entity_id")).alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
    )


def upsert_relations(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One relation per key: highest confidence, latest evidence that isn't empty."""
    told = F.when(F.col("evidence_text") != "", F.struct("updated_at", "evidence_text"))
    return rows.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.max(told)["evidence_text"].alias("evidence_text"), F.max("updated_at").alias("updated_at"))


def redirect(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges with merged entities (loser, keeper) replaced by their keepers; what becomes a loop or a repetition goes."""
    for side in (SUBJECT, OBJECT):
        names = merged.select(F.col("loser").alias(side), F.col("keeper").alias("_keeper"))
        edges = edges.join(names, side, "left").withColumn(side, F.coalesce("_keeper", side)).drop("_keeper")
    return edges.where(F.col(SUBJECT) != F.col(OBJECT)).distinct()


def merged_entities(entities: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges after merges (loser, keeper): the keeper has the names and aliases of both, losers go, edges are redirected."""
    lost = merges.join(entities.select(F.col("entity_id").alias("loser"), "name", "aliases"), "loser").groupBy("keeper").agg(F.array_distinct(F.flatten(F.collect_list(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))))).alias("_more"))
    kept = entities.join(merges.select(F.col("loser").alias("entity_id")), "entity_id", "left_anti").join(lost.withColumnRenamed("keeper", "entity_id"), "entity_id", "left")
    both = F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>")))
    return kept.withColumn("aliases", F.array_sort(F.filter(both, lambda x: x != F.col("name")))).select(*entities.columns), redirect(edges, merges)


def bridged(rows: DataFrame, bridge: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Principles, examples or warnings that a bridge table (key, entity_id) ties to any of the entities, each once."""
    return rows.join(bridge.join(entities.select("entity_id"), "entity_id", "left_semi").select(key), key, "left_semi")


def listed(entities: DataFrame, *, layer: str | None = None, status: str | None = None, library: str | None = None) -> DataFrame:
    """Entities of a layer, a status, a library."""
    for column, value in (("layer", layer), ("status", status), ("library_id", library)):
        if value is not None:
            entities = entities.where(F.col(column) == value)
    return entities


def documents_of(edges: DataFrame, entity: str) -> DataFrame:
    """Documents with an edge at an entity, each once."""
    return edges.where((F.col(SUBJECT) == entity) | (F.col(OBJECT) == entity)).select("doc_id").distinct()


def removed(entities: DataFrame, edges: DataFrame, tombstones: DataFrame, gone: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, edges and tombstones (library_id, name, deleted_at) after entities (entity_id) are deleted: with their edges, and
    remembered by name, so that they don't come back by themselves."""
    lost = entities.join(gone.select("entity_id"), "entity_id", "left_semi")
    known = tombstones.unionByName(lost.select("library_id", "name", at.alias("deleted_at")))
    ids = lost.select("entity_id")
    rest = edges.join(ids.withColumnRenamed("entity_id", SUBJECT), SUBJECT, "left_anti").join(ids.withColumnRenamed("entity_id", OBJECT), OBJECT, "left_anti").select(*edges.columns)
    return entities.join(ids, "entity_id", "left_anti"), rest, known.groupBy("library_id", "name").agg(F.max("deleted_at").alias("deleted_at"))


def restored(tombstones: DataFrame, names: DataFrame) -> DataFrame:
    """Tombstones without those of names (library_id, name) that may come back; what was deleted stays so."""
    return tombstones.join(names.select("library_id", "name"), ["library_id", "name"], "left_anti")


def without_deleted(names: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Names (library_id, name, ...) that weren't deleted."""
    return names.join(tombstones.select("library_id", "name"), ["library_id", "name"], "left_anti").select(*names.columns)


def final_keepers(merges: DataFrame, *, hops: int = 5) -> DataFrame:
    """(loser, keeper) with chains of merges followed to their end; rings and chains of more than `hops` are rejected."""
    now = merges.select("loser", F.col("keeper").alias("at"), F.lit(1).alias("n"), F.array("loser").alias("seen"))
    step = merges.select(F.col("loser").alias("at"), F.col("keeper").alias("next"))
    for _ in range(hops):
        joined = now.join(step, "at", "left")
        now = joined.select("loser", F.coalesce("next", "at").alias("at"), F.when(F.col("next").isNotNull(), F.col("n") + 1).otherwise(F.col("n")).alias("n"), F.when(F.col("next").isNotNull(), F.array_append("seen", F.col("at"))).otherwise(F.col("seen")).alias("seen"))
    open_ = now.join(step.select("at").distinct().withColumn("more", F.lit(True)), "at", "left")
    return open_.where("more IS NULL").where(~F.array_contains("seen", F.col("at"))).select("loser", F.col("at").alias("keeper"))


def cooccurrences(docs: DataFrame, key: str, text: str, terms: Sequence[str], *, within: int = 200) -> DataFrame:
    """(first, second, n_docs): terms that occur within so many characters of each other, by first occurrence, in how many texts."""
    places = F.array(*(F.struct(F.lit(t).alias("term"), F.instr(F.col(text), t).alias("at")) for t in sorted(terms)))
    rows = docs.select(F.col(key).alias("key"), F.filter(places, lambda p: p["at"] > 0).alias("places"))
    pairs = F.flatten(F.transform("places", lambda a: F.transform(F.filter("places", lambda b: (a["term"] < b["term"]) & (F.abs(a["at"] - b["at"]) <= within)), lambda b: F.struct(a["term"].alias("first"), b["term"].alias("second")))))
    return rows.select("key", F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.countDistinct("key").alias("n_docs"))


# ---------------------------------------------------------------- trees


def _parents(nodes: DataFrame) -> DataFrame:
    """(node_id, parent_id) with one row a node: of several parents the smallest counts."""
    return nodes.where("node_id IS NOT NULL").groupBy("node_id").agg(F.min("parent_id").alias("parent_id"))


def subtree(nodes: DataFrame, root: str) -> DataFrame:
    """(node_id, depth) below and including a root, by path doubling: each node points to its parent, then to the node that its
    parent points to, and so on, until it points to the root or to nothing. Rounds, each written, grow with the logarithm of the
    depth; nodes of a ring without the root never get there and end with the rounds that all nodes together could need."""
    state = _parents(nodes).select("node_id", F.when(F.col("node_id") != root, F.col("parent_id")).alias("ptr"), F.lit(1).cast("long").alias("steps"), F.when(F.col("node_id") == root, F.lit(0).cast("long")).alias("depth"))
    state = written(state)
    for _ in range(state.count().bit_length() + 1):
        if state.where("depth IS NULL AND ptr IS NOT NULL").isEmpty():
            break
        ahead = state.select(F.col("node_id").alias("ptr"), F.col("ptr").alias("next"), F.col("steps").alias("more"), F.col("depth").alias("below"))
        done, open_ = state.where("depth IS NOT NULL OR ptr IS NULL"), state.where("depth IS NULL AND ptr IS NOT NULL")
        moved = open_.join(ahead, "ptr").select("node_id", "next", (F.col("steps") + F.col("more")).alias("steps"), (F.col("steps") + F.col("below")).alias("depth"))
        state = written(done.unionByName(moved.withColumnRenamed("next", "ptr")))
    return state.where("depth IS NOT NULL").select("node_id", "depth")


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(node_id, path): titles from the root down, parted by ` / `, by path doubling: a node's path so far is put behind that
    of the node it points to. Nodes below a parent that doesn't exist and nodes of rings have no path; a null title is left out."""
    titles = nodes.groupBy("node_id").agg(F.min("title").alias("path"))
    state = written(_parents(nodes).join(titles, "node_id").select("node_id", F.col("parent_id").alias("ptr"), F.concat_ws(" / ", "path").alias("path")))
    for _ in range(state.count().bit_length() + 1):
        open_ = state.where("ptr IS NOT NULL")
        if open_.isEmpty():
            break
        ahead = state.select(F.col("node_id").alias("ptr"), F.col("ptr").alias("next"), F.nullif("path", F.lit("")).alias("above"))
        moved = open_.join(ahead, "ptr").select("node_id", F.col("next").alias("ptr"), F.concat_ws(" / ", "above", F.nullif("path", F.lit(""))).alias("path"))
        state = written(state.where("ptr IS NULL").unionByName(moved))
    return state.where("ptr IS NULL").select("node_id", "path")


def children(nodes: DataFrame, parent: str | None, *, scope: str | None = None) -> DataFrame:
    """Nodes right below a parent (None: the roots), in their order, those deleted left out."""
    rows = nodes.where(F.col("parent_id").isNull() if parent is None else F.col("parent_id") == parent)
    if scope is not None:
        rows = rows.where(F.col("scope_id") == scope)
    if "deleted" in nodes.columns:
        rows = rows.where("NOT deleted")
    return rows.orderBy("sort_order", "node_id")


def inserted(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes with new ones (same columns) after the siblings there are, where they have no order of their own; known ids are replaced."""
    kept = nodes.join(new.select("node_id"), "node_id", "left_anti")
    last = kept.groupBy("parent_id").agg(F.max("sort_order").alias("_last"))
    rank = F.row_number().over(Window.partitionBy("parent_id", F.col("sort_order") < 0).orderBy("node_id"))
    rows = new.withColumn("_n", rank).join(last.withColumnRenamed("parent_id", "_parent"), F.col("parent_id").eqNullSafe(F.col("_parent")), "left")
    order = F.when(F.coalesce("sort_order", F.lit(-1)) < 0, F.coalesce("_last", F.lit(-1)) + F.col("_n")).otherwise(F.col("sort_order"))
    return kept.unionByName(rows.withColumn("sort_order", order.cast(dict(nodes.dtypes)["sort_order"])).select(*nodes.columns))


def moved(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Nodes with some moved (node_id, parent_id) to the end of their new siblings; siblings they left and joined are numbered anew."""
    to = moves.select("node_id", F.col("parent_id").alias("_to"), F.lit(True).alias("_moves"))
    rows = nodes.join(to, "node_id", "left").withColumn("_moves", F.coalesce("_moves", F.lit(False)))
    touched = rows.where("_moves").select(F.explode(F.array(F.coalesce("parent_id", F.lit("")), F.coalesce("_to", F.lit("")))).alias("_key")).distinct().withColumn("_touched", F.lit(True))
    rows = rows.withColumn("parent_id", F.when(F.col("_moves"), F.col("_to")).otherwise(F.col("parent_id"))).withColumn("_key", F.coalesce("parent_id", F.lit("")))
    rows = rows.join(touched, "_key", "left")
    place = F.row_number().over(Window.partitionBy("_key").orderBy("_moves", "sort_order", "node_id")) - 1
    return rows.withColumn("sort_order", F.when(F.col("_touched"), place).otherwise(F.col("sort_order")).cast(dict(nodes.dtypes)["sort_order"])).select(*nodes.columns)


def soft_deleted(nodes: DataFrame, root: str) -> DataFrame:
    """Nodes with all below a root, and it, marked deleted."""
    gone = subtree(nodes, root).select("node_id", F.lit(True).alias("_gone"))
    return nodes.join(gone, "node_id", "left").withColumn("deleted", F.coalesce("_gone", "deleted")).select(*nodes.columns)


def delete_preview(nodes: DataFrame, root: str, *, folder: Column | None = None, shown: int = 5) -> DataFrame:
    """What deleting a node takes away, in one row: total_nodes, folder_count, document_count, and the titles of the first documents."""
    is_folder = F.col("is_folder") if folder is None else folder
    below = nodes.join(subtree(nodes, root).select("node_id"), "node_id", "left_semi")
    counts = below.agg(F.count("*").alias("total_nodes"), F.count_if(is_folder).alias("folder_count"), F.count_if(~is_folder).alias("document_count"))
    first = below.where(~is_folder).orderBy("title", "node_id").limit(shown).agg(F.sort_array(F.collect_list("title")).alias("titles"))
    return counts.join(F.broadcast(first))


def outlines(blocks: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(outline_id, doc_id, title, level, page_idx, anchor_block_id, parent_outline_id, printed_page_label): titles as a flat outline;
    a parent counts if it is a title with a level itself."""
    rows = blocks.where((F.col("block_type") == "title") & (F.trim("text") != "") & F.col("title_level").isNotNull())
    named = rows.select(F.col("block_id").alias("parent_id"), F.concat(F.lit("outline:"), "block_id").alias("parent_outline_id"))
    out = rows.join(named, "parent_id", "left").select(F.concat(F.lit("outline:"), "block_id").alias("outline_id"), "doc_id", F.trim("text").alias("title"), F.col("title_level").alias("level"), "page_idx", F.col("block_id").alias("anchor_block_id"), "parent_outline_id")
    if labels is None:
        return out.withColumn("printed_page_label", F.lit(None).cast("string"))
    return out.join(labels.select("doc_id", "page_idx", F.col("label").alias("printed_page_label")), ["doc_id", "page_idx"], "left")


def next_order(nodes: DataFrame) -> DataFrame:
    """(parent_id, next_order): one more than the highest order of the siblings."""
    return nodes.groupBy("parent_id").agg((F.max("sort_order") + 1).alias("next_order"))


def renumbered(nodes: DataFrame) -> DataFrame:
    """Siblings numbered 0, 1, ... in their order."""
    order = Window.partitionBy("parent_id").orderBy("sort_order", "node_id")
    return nodes.withColumn("sort_order", (F.row_number().over(order) - 1).cast("long"))


def cycles_and_gaps(steps: DataFrame) -> DataFrame:
    """(step_id, problem) of a step graph (step_id, next_id), each step with one successor at most: `dangling` successors that
    don't exist, and members of a `cycle`.

    Successors double their reach each round. What is reached after more moves was reached after fewer, so once it is as much as the round before,
    moves only permute it: it is the members of cycles. Rounds grow with the logarithm of the longest way into a cycle or to an end, not of all steps;
    moves are as many as steps, so no side of their join is broadcast.
    """
    known = steps.select(F.col("step_id").alias("next_id")).distinct()
    dangling = steps.where("next_id IS NOT NULL").join(known, "next_id", "left_anti").select("step_id", F.lit("dangling").alias("problem"))
    moves = written(steps.where("next_id IS NOT NULL").join(known, "next_id", "left_semi").select("step_id", "next_id"))
    reached, before = moves.select("next_id").distinct().count(), None
    while reached != before:
        ahead = moves.select(F.col("step_id").alias("next_id"), F.col("next_id").alias("beyond"))
        moves = written(moves.join(ahead.hint("merge"), "next_id").select("step_id", F.col("beyond").alias("next_id")))
        before, reached = reached, moves.select("next_id").distinct().count()
    return dangling.union(moves.select(F.col("next_id").alias("step_id")).distinct().withColumn("problem", F.lit("cycle")))

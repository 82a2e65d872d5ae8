"""Weighted skill graph: lookup, traversal, subgraphs and similarity.

``skills`` has ``id, name, category, aliases, seq``; ``relations`` has ``source, target,
relation, weight, seq`` where ``seq`` is the order of entry.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright import fixed_values as fv
from pairwright.operators.bitmaps import held, map_of, pair_hashes
from pairwright.operators.skew import salted_join, spread_tasks
from pairwright.session import cut_lineage, in_waves

#: Nodes with more edges than this are heavy: their neighbours are never gathered in one row.
LIGHT_DEGREE = 1000
#: Groups that share the relations around them in one task; blocks with too many relations are cut to the next size.
GROUPS_PER_BLOCK = (1024, 16)
#: Most relations that one task holds for its block of groups; groups beyond that are joined row by row.
BLOCK_RELATIONS = 2_000_000
#: Edges behind the skills of a block and asked skills in it, on the average, and the bits of its map of pairs (8 MB).
BLOCK_EDGES, BLOCK_ASKED, BLOCK_BITS = 200_000, 400_000, 1 << 26
#: Rows that a step may shuffle at once; more are done one part after the other, each part written before the next.
WAVE_ROWS = 100_000_000

SKILL_SCHEMA = "id string, name string, category string, aliases array<string>, seq int"
RELATION_SCHEMA = "source string, target string, relation string, weight double, seq bigint"


def default_taxonomy(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The packaged seed graph as (skills, relations)."""
    skills = [
        (skill, name, category, aliases)
        for category, group in fv.TAXONOMY_SKILLS.items() for skill, name, aliases in group
    ]
    relations = [
        (needs, base, "requires", fv.FRAMEWORK_WEIGHT)
        for base, group in fv.TAXONOMY_FRAMEWORKS for needs in group
    ]
    for group, relation, weight in fv.TAXONOMY_GROUPS:
        relations += [
            (a, b, relation, weight) for i, a in enumerate(group) for b in group[i + 1:]
        ]
    relations += [(a, b, "requires", fv.REQUIRES_WEIGHT) for a, b in fv.TAXONOMY_REQUIRES]
    return (
        spark.createDataFrame([(*row, i) for i, row in enumerate(skills)], SKILL_SCHEMA),
        spark.createDataFrame([(*row, i) for i, row in enumerate(relations)], RELATION_SCHEMA),
    )


def skill_edges(relations: DataFrame) -> DataFrame:
    """Directed edges ``src, dst, relation, weight, seq``; two-way relations appear twice."""
    two_way = F.col("relation").isin(*fv.TWO_WAY_RELATIONS)
    ends = F.array_compact(F.array(
        F.struct(F.col("source").alias("src"), F.col("target").alias("dst"),
                 (F.col("seq") * 2).alias("seq")),
        F.when(two_way, F.struct(F.col("target").alias("src"), F.col("source").alias("dst"),
                                 (F.col("seq") * 2 + 1).alias("seq"))),
    ))
    return relations.withColumn("_e", F.explode(ends)).select(
        "_e.src", "_e.dst", "relation", "weight", "_e.seq"
    )


def skill_lookup(names: DataFrame, skills: DataFrame, name: str = "name") -> DataFrame:
    """Skill id per asked name: by id, then by name, then by alias, in any case."""
    keys = F.concat(
        F.array(
            F.struct(F.lower("id").alias("key"), F.lit(0).alias("prio")),
            F.struct(F.lower("name").alias("key"), F.lit(1).alias("prio")),
        ),
        F.transform(
            F.coalesce("aliases", F.array().cast("array<string>")),
            lambda a: F.struct(F.lower(a).alias("key"), F.lit(2).alias("prio")),
        ),
    )
    # within one kind of key, the skill entered last owns it
    index = (
        skills.select("id", "seq", F.explode(keys).alias("_k"))
        .groupBy(F.col("_k.key").alias("_key"))
        .agg(F.min_by("id", F.struct(F.col("_k.prio"), -F.col("seq"))).alias("skill_id"))
    )
    return names.withColumn("_key", F.lower(name)).join(index, "_key", "left").drop("_key")


def skills_by_category(skills: DataFrame, category: str | None = None) -> DataFrame:
    """Skills of one category, or all ordered by category."""
    chosen = skills if category is None else skills.where(F.col("category") == category)
    return chosen.orderBy("category", "seq")


def _hop(frontier: DataFrame, lists: DataFrame, group: str) -> DataFrame:
    """The frontier's rows with the neighbours of their node; a node with many has several rows, one without has none."""
    return frontier.join(lists, "node", "left").select(group, "node", "weight", "_next")


def _products(hop: DataFrame, group: str, own: bool) -> DataFrame:
    """Products of weights one hop farther, and with ``own`` those that led here."""
    following = F.coalesce("_next", F.array().cast(hop.schema["_next"].dataType))
    if own:
        following = F.concat(F.array(F.struct(F.col("node"), F.lit(1.0).alias("_w"))), following)
    return hop.select(group, F.col("weight").alias("_v"), F.inline(following)).select(
        group, "node", (F.col("_v") * F.col("_w")).alias("weight")).where(F.col("node") != F.col(group))


def related_skills(
    seeds: DataFrame, edges: DataFrame, max_depth: int = 1,
    relations: Sequence[str] | None = None, seed: str = "seed",
) -> DataFrame:
    """``seed, node, weight``: nodes within ``max_depth + 1`` hops and the best path weight.

    A path's weight is the product of its edges. Nodes reached on several paths keep the
    largest weight, which does not depend on the order of edges.
    """
    used = edges if relations is None else edges.where(F.col("relation").isin(*relations))
    best = used.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    # a row holds at most so many neighbours, however many a node has
    piece = F.floor(F.row_number().over(Window.partitionBy("src").orderBy("dst")) / LIGHT_DEGREE)
    lists = cut_lineage(best.withColumn("_piece", piece).groupBy(F.col("src").alias("node"), "_piece").agg(
        F.collect_list(F.struct(F.col("dst").alias("node"), F.col("weight").alias("_w"))).alias("_next")).drop("_piece"))
    frontier = seeds.select(seed, F.col(seed).alias("node"), F.lit(1.0).alias("weight")).where(F.col(seed).isNotNull()).distinct()
    reached = None
    for _ in range(max_depth):
        frontier = cut_lineage(_products(_hop(frontier, lists, seed), seed, False).groupBy(seed, "node").agg(
            F.max("weight").alias("weight")))
        reached = frontier if reached is None else reached.unionByName(frontier)
    if reached is None:
        return _products(_hop(frontier, lists, seed), seed, False).groupBy(seed, "node").agg(F.max("weight").alias("weight"))
    spark = seeds.sparkSession
    many = frontier.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).join(lists, "node").agg(
        F.sum(F.col("_n") * F.size("_next"))).first()[0] or 0
    heavy = cut_lineage(frontier.groupBy(seed).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LIGHT_DEGREE).select(seed))
    some_heavy = not heavy.isEmpty()
    earlier = None
    if max_depth > 1:
        earlier = reached.withColumn("_next", F.lit(None).cast(lists.schema["_next"].dataType)).select(seed, "node", "weight", "_next")

    def wave(chosen: Callable[[DataFrame], DataFrame]) -> DataFrame:
        hop = _hop(chosen(frontier), lists, seed)
        hop = hop if earlier is None else hop.unionByName(chosen(earlier))
        # neighbours travel as lists to their seed, which is complete in its task; a seed of very many is not
        light = hop.join(heavy, seed, "left_anti") if some_heavy else hop
        found = _products(light.repartition(spread_tasks(spark), seed), seed, True).groupBy(seed, "node").agg(
            F.max("weight").alias("weight"))
        if some_heavy:
            found = found.unionByName(_products(hop.join(heavy, seed, "left_semi"), seed, True).groupBy(seed, "node").agg(
                F.max("weight").alias("weight")))
        return found

    return in_waves(spark, -(-many // WAVE_ROWS), seed, wave)


def _neighbourhood(members: DataFrame, edges: DataFrame, hops: int, group: str) -> DataFrame:
    """Group members and everything within ``hops`` expansions of two edges each."""
    links = cut_lineage(edges.select(F.col("src").alias("node"), "dst").distinct())
    nodes = members.select(group, "node").distinct()
    frontier = nodes
    for _ in range(2 * hops):
        frontier = cut_lineage(
            salted_join(frontier, links, ["node"], salts=4, spread_by=[group])
            .select(group, F.col("dst").alias("node")).distinct()
            .join(nodes, [group, "node"], "left_anti")
        )
        nodes = nodes.unionByName(frontier)
    return nodes


def skill_subgraph(
    members: DataFrame, skills: DataFrame, relations: DataFrame, hops: int = 1, group: str = "group_id",
) -> tuple[DataFrame, DataFrame]:
    """Nodes and relations around each group of seed skills (``group_id, node``).

    Relations are kept when both ends are inside; unknown seeds have no node.
    """
    relations = cut_lineage(relations)
    edges = skill_edges(relations)
    reached = _neighbourhood(members, edges, hops, group)
    nodes = reached.join(skills.select(F.col("id").alias("node")), "node", "left_semi")
    starts = salted_join(
        reached.select(group, F.col("node").alias("source")), relations, ["source"], salts=4,
        spread_by=[group],
    )
    inside = starts.join(
        reached.select(group, F.col("node").alias("target")), [group, "target"], "left_semi"
    )
    return nodes, inside


def _count_bits(words: np.ndarray) -> np.ndarray:
    """How many of the words hold each of the 64 bits."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(words), 255 * 512):
        part = words[start:start + 255 * 512]
        rows = np.zeros(-(-len(part) // 255) * 255, np.uint64)
        rows[:len(part)] = part
        rows = rows.reshape(-1, 255)  # as many ones as a byte can count
        for bit in range(8):
            sums = ((rows >> np.uint64(bit)) & np.uint64(0x0101010101010101)).sum(axis=1, dtype=np.uint64)
            counts[bit::8] += sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def _block_sizes(group: str, hops: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Sizes of the groups of one block: 64 groups at a time, a bit of a word for each group."""

    def run(members: pa.Table, near: pa.Table) -> pa.Table:
        ends = [members.column("node"), near.column("source"), near.column("target")]
        coded = pa.chunked_array([c for column in ends for c in column.chunks], pa.string()).combine_chunks().dictionary_encode()
        nodes = coded.indices.to_numpy()
        seeds, src, dst = np.split(nodes, np.cumsum([len(column) for column in ends])[:2])
        two_way, src_known, dst_known = (
            near.column(c).to_numpy().astype(bool) for c in ("_two_way", "_source_known", "_target_known"))
        known = np.zeros(len(coded.dictionary), bool)
        known[seeds], known[src], known[dst] = members.column("_known").to_numpy().astype(bool), src_known, dst_known
        both = src_known & dst_known
        begin, end = np.concatenate([src, dst[two_way]]), np.concatenate([dst, src[two_way]])
        order = np.argsort(end, kind="stable")
        begin, end = begin[order], end[order]
        first = np.flatnonzero(np.diff(end, prepend=-1))
        owners = members.column(group).combine_chunks().dictionary_encode()
        owner = owners.indices.to_numpy()
        sizes = np.zeros((3, len(owners.dictionary)), np.int64)
        for start in range(0, sizes.shape[1], 64):
            held = (owner >= start) & (owner < start + 64)
            inside = np.zeros(len(known), np.uint64)
            np.bitwise_or.at(inside, seeds[held], np.uint64(1) << (owner[held] - start).astype(np.uint64))
            for _ in range(2 * hops if len(first) else 0):
                reached = np.bitwise_or.reduceat(inside[begin], first)
                inside[end[first]] |= reached
            pairs = inside[src] & inside[dst]
            found = np.stack([
                _count_bits(inside[known]), _count_bits(pairs), _count_bits(pairs[both]) + _count_bits(pairs[both & two_way])])
            width = min(64, sizes.shape[1] - start)
            sizes[:, start:start + width] = found[:, :width]
        return pa.table({group: owners.dictionary, "nodes": sizes[0], "relations": sizes[1], "ends": sizes[2]})

    return run


def subgraph_sizes(
    members: DataFrame, skills: DataFrame, relations: DataFrame, hops: int = 1, group: str = "group_id",
) -> DataFrame:
    """``group, nodes, relations, ends``: how many rows ``skill_subgraph`` gives for each group.

    ``ends`` counts the directed edges between known skills. Groups with seeds close to each other form a block, the
    relations around a block reach its task once, and no node of a single group becomes a row. Blocks with more than
    ``BLOCK_RELATIONS`` relations are cut into smaller ones, and what even those cannot hold is joined row by row.
    """
    spark = members.sparkSession
    ids = skills.select(F.col("id").alias("node"), F.lit(True).alias("_known")).distinct()
    known = F.coalesce("_known", F.lit(False))
    plain = relations.where(F.col("source").isNotNull() & F.col("target").isNotNull())
    relations = cut_lineage(
        plain.join(ids.withColumnsRenamed({"node": "source", "_known": "_s"}), "source", "left")
        .join(ids.withColumnsRenamed({"node": "target", "_known": "_t"}), "target", "left")
        .select(*relations.columns, F.coalesce(F.col("relation").isin(*fv.TWO_WAY_RELATIONS), F.lit(False)).alias("_two_way"),
                F.coalesce("_s", F.lit(False)).alias("_source_known"), F.coalesce("_t", F.lit(False)).alias("_target_known")))
    sent = relations.select("source", "target", "_two_way", "_source_known", "_target_known")
    links = cut_lineage(sent.select(F.col("source").alias("node"), F.col("target").alias("dst")).unionByName(
        sent.where("_two_way").select(F.col("target").alias("node"), F.col("source").alias("dst"))).distinct())
    degree = cut_lineage(sent.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("_n")))
    left = cut_lineage(members.where(F.col("node").isNotNull()).select(group, "node").distinct().join(ids, "node", "left").select(
        group, "node", known.alias("_known")))
    schema = T.StructType([left.schema[group], *(T.StructField(c, T.LongType()) for c in ("nodes", "relations", "ends"))])
    sizes = None
    for most in GROUPS_PER_BLOCK:
        # neighbours in the order of their first seed: ids given in one go are often close in the graph too
        lowest = left.groupBy(group).agg(F.min(F.struct(F.length("node").alias("l"), "node")).alias("_low"))
        n = lowest.count()
        blocks = max(-(-n // most), min(-(-n // 64), spark.sparkContext.defaultParallelism), 1)
        placed = left.join(cut_lineage(lowest.repartitionByRange(blocks, "_low").select(
            group, F.spark_partition_id().alias("_b"))), group)
        placed = cut_lineage(placed)
        ring = cut_lineage(placed.select("_b", "node").distinct())
        for _ in range(2 * hops):
            step = salted_join(links, ring, ["node"], salts=4, spread_by=["dst"]).select("_b", F.col("dst").alias("node"))
            ring = cut_lineage(ring.unionByName(step).distinct())
        heavy = cut_lineage(ring.join(degree, "node").groupBy("_b").agg(F.sum("_n").alias("_n")).where(
            F.col("_n") > BLOCK_RELATIONS).select("_b"))
        tasks = max(spread_tasks(spark), blocks)
        near = salted_join(sent, ring.join(F.broadcast(heavy), "_b", "left_anti").withColumnRenamed("node", "source"),
                           ["source"], salts=4, spread_by=["target"])
        found = placed.join(F.broadcast(heavy), "_b", "left_anti").repartition(tasks, "_b").groupBy("_b").cogroup(
            near.repartition(tasks, "_b").groupBy("_b")).applyInArrow(_block_sizes(group, hops), schema)
        sizes = found if sizes is None else sizes.unionByName(found)
        if heavy.isEmpty():
            return sizes
        left = cut_lineage(placed.join(heavy, "_b", "left_semi").drop("_b"))
    nodes, inside = skill_subgraph(left, skills, relations, hops, group)
    both = F.col("_source_known") & F.col("_target_known")
    counted = inside.groupBy(group).agg(
        F.count(F.lit(1)).alias("relations"), F.coalesce(F.sum(F.when(both, F.when(F.col("_two_way"), 2).otherwise(1))), F.lit(0)).alias("ends"))
    joined = left.select(group).distinct().join(nodes.groupBy(group).agg(F.count(F.lit(1)).alias("nodes")), group, "left").join(
        counted, group, "left").fillna(0, ["nodes", "relations", "ends"])
    return sizes.unionByName(joined.select(*schema.names))


def _neighbour_hashes(edges: DataFrame, node: str, other: str, name: str) -> DataFrame:
    """(node, name): hashes of the nodes beside a light node, null for a heavy one, whose list has no bound."""
    degree = edges.groupBy(node).agg(F.count(F.lit(1)).alias("_n"))
    light = edges.join(degree.where(F.col("_n") <= LIGHT_DEGREE), node, "left_semi").groupBy(node).agg(
        F.collect_set(F.hash(other)).alias(name))
    heavy = degree.where(F.col("_n") > LIGHT_DEGREE).select(node, F.lit(None).cast("array<int>").alias(name))
    return light.unionByName(heavy)


def _block_links(asked: pa.Table, around: pa.Table) -> pa.Table:
    """The asked pairs of a block that an edge or two may join, by a map of bits of all pairs that they do join."""
    if not asked.num_rows or not around.num_rows:
        return pa.table({"skill1": pa.array([], pa.string()), "skill2": pa.array([], pa.string())})
    far = around.column("_far").combine_chunks()
    node = around.column("_h1").to_numpy()
    bits = map_of(pair_hashes(np.repeat(node, np.diff(far.offsets.to_numpy())), far.flatten().to_numpy()), BLOCK_BITS)
    heavy = np.unique(node[around.column("_heavy").to_numpy().astype(bool)])
    wanted, hashes = asked.column("_r").combine_chunks(), asked.column("_h2").combine_chunks()
    owner = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
    own = asked.column("_h1").to_numpy()[owner]
    kept = np.flatnonzero(held(bits, pair_hashes(own, hashes.flatten().to_numpy())) | np.isin(own, heavy))
    return pa.table({"skill1": asked.column("skill1").combine_chunks().take(pa.array(owner[kept])), "skill2": wanted.flatten().take(pa.array(kept))})


def _linked(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (skill1, skill2) of ``skill1, _r`` (a list of second skills) that one or two edges may join.

    Skills are dealt to blocks with what lies one and two edges behind them, as hashes; the pairs of a block are looked up in
    a map of bits, so a few of those left have no path. Pairs whose path may lead through a heavy node all stay.
    """
    spark = asked.sparkSession
    asked = asked.where(F.col("skill1").isNotNull() & (F.size("_r") > 0))
    after = cut_lineage(_neighbour_hashes(edges, "src", "dst", "_after"))
    none = F.array().cast("array<int>")
    known = after.select(F.col("src").alias("dst"), "_after", F.lit(True).alias("_met"))
    ways = edges.select("src", "dst").join(after.where(F.col("_after").isNotNull()).select("src"), "src", "left_semi").join(known, "dst", "left").select(
        "src", F.concat(F.array(F.hash("dst")), F.coalesce("_after", none)).alias("_far"),
        (F.col("_after").isNull() & F.coalesce("_met", F.lit(False))).alias("_heavy"))
    ways = ways.unionByName(after.where(F.col("_after").isNull()).select("src", none.alias("_far"), F.lit(True).alias("_heavy")))
    lines, many = edges.count(), asked.count()
    blocks = max(spread_tasks(spark), -(-lines // BLOCK_EDGES), -(-many // BLOCK_ASKED))

    def wave(chosen: Callable[[DataFrame], DataFrame]) -> DataFrame:
        def dealt(df: DataFrame, key: str, *columns: Column | str) -> DataFrame:
            rows = chosen(df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))).select("_b", F.hash(key).alias("_h1"), *columns)
            return rows.repartition(min(blocks, spread_tasks(spark)), "_b").groupBy("_b")

        left = dealt(asked, "skill1", "skill1", "_r", F.transform("_r", lambda x: F.hash(x)).alias("_h2"))
        return left.cogroup(dealt(ways, "src", "_far", "_heavy")).applyInArrow(_block_links, "skill1 string, skill2 string").distinct()

    return in_waves(spark, -(-max(lines, many) // WAVE_ROWS), "_b", wave)


def skill_similarity(pairs: DataFrame, skills: DataFrame, edges: DataFrame) -> DataFrame:
    """Similarity of asked (skill1, skill2) pairs, in the direction of the edges.

    1 for the same skill; 0 if unknown; the first direct edge; else half the product of the
    first two-edge path; else 0.3 inside a category; else 0.
    """
    # both are read by several branches below
    asked = cut_lineage(pairs.select("skill1", "skill2").distinct())
    edges = cut_lineage(edges.select("src", "dst", "weight", "seq"))
    linked = cut_lineage(_linked(asked.select("skill1", F.array("skill2").alias("_r")), edges))
    return _similarities(asked, linked, skills, edges)


def _similarities(asked: DataFrame, linked: DataFrame, skills: DataFrame, edges: DataFrame) -> DataFrame:
    """``skill_similarity`` of distinct pairs, of which ``linked`` holds all that one or two edges join."""
    direct = linked.join(
        edges.select(F.col("src").alias("skill1"), F.col("dst").alias("skill2"), "weight", "seq"),
        ["skill1", "skill2"],
    ).groupBy("skill1", "skill2").agg(F.min_by("weight", "seq").alias("_direct"))
    before = _neighbour_hashes(edges, "dst", "src", "_before").withColumnRenamed("dst", "skill2")
    # written between the joins, so that the edges lie in one shuffle at a time
    firsts = cut_lineage(linked.join(before, "skill2").join(edges.select(
        F.col("src").alias("skill1"), F.col("dst").alias("_mid"), F.col("weight").alias("_w1"), F.col("seq").alias("_s1"),
    ), "skill1").where(F.coalesce(F.array_contains("_before", F.hash("_mid")), F.lit(True))).drop("_before"))
    seconds = edges.select(F.col("src").alias("_mid"), F.col("dst").alias("skill2"),
                           F.col("weight").alias("_w2"), F.col("seq").alias("_s2"))
    two_hop = cut_lineage(firsts.join(seconds, ["_mid", "skill2"]).groupBy("skill1", "skill2").agg(
        F.min_by(F.col("_w1") * F.col("_w2") * fv.TWO_HOP_DISCOUNT, F.struct("_s1", "_s2")).alias("_two")
    ))
    known = skills.select("id", "category")
    joined = (
        asked.join(cut_lineage(direct), ["skill1", "skill2"], "left").join(two_hop, ["skill1", "skill2"], "left")
        .join(known.select(F.col("id").alias("skill1"), F.col("category").alias("_c1")), "skill1", "left")
        .join(known.select(F.col("id").alias("skill2"), F.col("category").alias("_c2")), "skill2", "left")
    )
    value = (
        F.when(F.col("skill1") == F.col("skill2"), F.lit(1.0))
        .when(F.col("_c1").isNull() | F.col("_c2").isNull(), F.lit(0.0))
        .otherwise(F.coalesce(
            "_direct", "_two",
            F.when(F.col("_c1") == F.col("_c2"), F.lit(fv.SAME_CATEGORY_SIMILARITY)),
            F.lit(0.0),
        ))
    )
    return joined.select("skill1", "skill2", value.alias("similarity"))


def match_similarities(matches: DataFrame, skills: DataFrame, edges: DataFrame, above: float = 0.3,
                       resume_skills: str = "resume_skills", job_skills: str = "job_skills") -> DataFrame:
    """``skill1, skill2, similarity`` above a bound, of the pairs that a match asks for.

    Those are a skill that only the resume holds and one that only the job asks for; no other pair is looked up.
    """
    none = F.array().cast("array<string>")
    mine, wanted = F.coalesce(resume_skills, none), F.coalesce(job_skills, none)
    asked = matches.select(F.array_except(mine, wanted).alias("_l"), F.array_except(wanted, mine).alias("_r")).select(
        F.explode("_l").alias("skill1"), "_r")
    if above < fv.SAME_CATEGORY_SIMILARITY:
        found = skill_similarity(asked.select("skill1", F.explode("_r").alias("skill2")), skills, edges)
    else:  # two different skills without a path are not above it
        edges = cut_lineage(edges.select("src", "dst", "weight", "seq"))
        linked = cut_lineage(_linked(asked, edges).distinct())
        found = _similarities(linked, linked, skills, edges)
    return found.where(F.col("similarity") > above)


def graph_statistics(skills: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, directed edges with known ends, relation types, edges per node."""
    ids = skills.select("id")
    known = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    nodes = skills.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = known.agg(F.count(F.lit(1)).alias("num_edges"))
    return counted.select(
        nodes.alias("num_nodes"), "num_edges", F.lit(len(fv.RELATION_TYPES)).alias("num_relation_types"),
        F.when(nodes > 0, F.col("num_edges") / nodes).otherwise(F.lit(0.0)).alias("avg_degree"),
    )


def graph_doc_features(doc_skills: DataFrame, skills: DataFrame, relations: DataFrame,
                       doc_id: str = "doc_id", skill: str = "skill") -> DataFrame:
    """Per document: known skills, and density and mean degree of their neighbourhood."""
    known = doc_skills.select(doc_id, F.col(skill).alias("node")).distinct().join(
        skills.select(F.col("id").alias("node")), "node", "left_semi"
    )
    counts = subgraph_sizes(known, skills, relations, 1, doc_id).select(
        doc_id, F.col("nodes").alias("_v"), F.col("ends").alias("_e"))
    own = known.groupBy(doc_id).agg(F.count(F.lit(1)).alias("num_skills"))
    joined = doc_skills.select(doc_id).distinct().join(own, doc_id, "left").join(counts, doc_id, "left")
    pairs = F.floor(F.coalesce("_e", F.lit(0)) / 2)
    v = F.coalesce("_v", F.lit(0))
    return joined.select(
        doc_id, F.coalesce("num_skills", F.lit(0)).alias("num_skills"),
        F.when(v > 1, pairs / (v * (v - 1) / 2)).otherwise(F.lit(0.0)).alias("graph_density"),
        F.when(v > 0, 2 * pairs / v).otherwise(F.lit(0.0)).alias("avg_degree"),
    )

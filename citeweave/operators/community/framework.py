"""Shared machinery of the community detectors.

State lives in DataFrames keyed by ``bin`` so every bin's graph is worked on
in the same job: ``edges(bin, src, dst, w)`` and ``member(bin, nid, comm)``
with dense ``bigint`` node ids.

A *local-moving round* proposes, for every node, the neighbouring community
with the best objective gain (a max over a struct, so a hub's candidates are
combined map-side instead of landing in one task).  Only a hashed subset of
nodes moves per round, which breaks symmetric swaps; the round is kept per
bin only if the exact objective improves, otherwise that bin retries with
half as many movers.  After ``MAX_HALVINGS`` halvings it goes on with moves of
which no two touch the same community (the best of both its communities each;
modularity gains of such moves add up exactly), and where these fail together,
with its single best move, whose gain is exact.  A bin ends when no node wants
to move; every kept round raises the objective, so it does end.  Membership is
checkpointed every round, and the table of the round before deleted.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.session import cut_lineage, release, small_table

EPS = 1e-12
MAX_HALVINGS = 4
VERBOSE = False


def weighted_edges(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(bin, src, dst, w): parallel edges summed into one weighted edge."""
    if "bin" not in edges.columns:
        edges = edges.withColumn("bin", F.lit(0).cast("bigint"))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return (edges.select("bin", "src", "dst", w.alias("w"))
            .groupBy("bin", "src", "dst").agg(F.sum("w").alias("w")))


def dense_rank_ids(df: DataFrame, order_cols: list, name: str,
                   per: str | None = None) -> DataFrame:
    """Append a dense 0-based index in ``order_cols`` order (restarting per
    ``per`` value when given).

    A distributed range sort; each row's index is its partition's offset
    (from per-partition row counts, one small row per partition) plus its
    position inside the partition.  No single task sees the whole table.
    """
    ordered = cut_lineage(df.orderBy(*order_cols)
                          .withColumn("_pid", F.spark_partition_id())
                          .withColumn("_mid", F.monotonically_increasing_id()))
    counts = sorted((r["_pid"], r["n"]) for r in
                    ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, acc = [], 0
    for pid, n in counts:
        offsets.append((pid, acc))
        acc += n
    spark = df.sparkSession
    off = small_table(spark, offsets or [(0, 0)], "_pid int, _off bigint")
    out = (ordered.join(F.broadcast(off), "_pid")
           .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
           .drop("_pid", "_mid", "_off"))
    if per is not None:
        start = out.groupBy(per).agg(F.min(name).alias("_s"))
        out = out.join(start, per).withColumn(name, F.col(name) - F.col("_s")).drop("_s")
    return out


def index_nodes(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Map string node ids to dense ids: returns (ids(bin, node, nid), edges
    in id space).  Nodes are the distinct endpoints (isolated works belong
    to no community)."""
    nodes = (edges.select("bin", F.col("src").alias("node"))
             .union(edges.select("bin", F.col("dst").alias("node"))).distinct())
    ids = cut_lineage(dense_rank_ids(nodes, ["bin", "node"], "nid"))
    s = ids.select("bin", F.col("node").alias("src"), F.col("nid").alias("s"))
    d = ids.select("bin", F.col("node").alias("dst"), F.col("nid").alias("d"))
    e = (edges.join(s, ["bin", "src"]).join(d, ["bin", "dst"])
         .select("bin", F.col("s").alias("src"), F.col("d").alias("dst"), "w"))
    return ids, cut_lineage(e)


def singletons(nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every node in its own community; ``keep`` node columns ride along
    (e.g. degrees), so later rounds need not join them back."""
    return nodes.select("bin", "nid", F.col("nid").alias("comm"), *keep)


def _extras(member: DataFrame) -> list[str]:
    return [c for c in member.columns if c not in ("bin", "nid", "comm")]


def neighbour_links(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(bin, nid, comm, wo, wi): weight from each node to / from each
    community, self-loops excluded.  Partial aggregation before the shuffle."""
    e = edges.where(F.col("src") != F.col("dst"))
    m_dst = member.select("bin", F.col("nid").alias("dst"), "comm")
    m_src = member.select("bin", F.col("nid").alias("src"), "comm")
    out_l = e.join(m_dst, ["bin", "dst"]).select(
        "bin", F.col("src").alias("nid"), "comm", F.col("w").alias("wo"), F.lit(0.0).alias("wi"))
    in_l = e.join(m_src, ["bin", "src"]).select(
        "bin", F.col("dst").alias("nid"), "comm", F.lit(0.0).alias("wo"), F.col("w").alias("wi"))
    return (out_l.union(in_l).groupBy("bin", "nid", "comm")
            .agg(F.sum("wo").alias("wo"), F.sum("wi").alias("wi")))


def with_own(links: DataFrame, member: DataFrame) -> DataFrame:
    """Candidate rows: every neighbouring community plus the node's own one,
    tagged with ``own`` (the node's current community)."""
    own = member.select("bin", "nid", F.col("comm").alias("own"), *_extras(member))
    stay = member.select("bin", "nid", "comm", F.lit(0.0).alias("wo"), F.lit(0.0).alias("wi"))
    cand = (links.union(stay).groupBy("bin", "nid", "comm")
            .agg(F.sum("wo").alias("wo"), F.sum("wi").alias("wi")))
    return cand.join(own, ["bin", "nid"])


def local_moving(member: DataFrame, gains: Callable[[DataFrame], DataFrame],
                 objective: Callable[[DataFrame], DataFrame], seed: int = 0,
                 log: list | None = None, hold_targets: bool = False) -> DataFrame:
    """Run rounds until every bin has converged; returns the membership.

    ``gains(member)`` yields (bin, nid, comm, own, gain) with gain 0 for
    staying; ``objective(member)`` yields (bin, obj), higher is better.  A column
    ``score`` beside the gain decides which candidate a node picks instead of the gain.
    With ``hold_targets`` no node moves into a community that loses a node in the same round.
    Extra columns of ``member`` (node attributes) are carried unchanged.
    """
    spark = member.sparkSession
    member = cut_lineage(member)
    extras = _extras(member)
    obj = {r["bin"]: r["obj"] for r in objective(member).collect()}
    halving = {b: 0 for b in obj}
    nomove: dict = {}
    active = list(obj)
    for rnd in count():
        started = time.time()
        if not active:
            break
        state = small_table(spark, [(b, 2 ** halving[b] if halving[b] <= MAX_HALVINGS
                                     else MAX_HALVINGS + 1 - halving[b]) for b in active], "bin bigint, stride bigint")
        g = gains(member)
        pick = [F.col("score"), F.col("gain")] if "score" in g.columns else [F.col("gain")]
        best = (g.groupBy("bin", "nid")
                .agg(F.max(F.struct(*pick, (-F.col("comm")).alias("nc"))).alias("b"),
                     F.max(F.when(F.col("comm") == F.col("own"), F.col("gain"))).alias("stay"),
                     F.first("own").alias("own")))
        wish = (best.join(F.broadcast(state), "bin")
                .where((F.col("b.gain") > F.col("stay") + EPS) & (-F.col("b.nc") != F.col("own")))
                .select("bin", "nid", "own", "stride", (-F.col("b.nc")).alias("new"),
                        (F.col("b.gain") - F.col("stay")).alias("rise")))
        # alternate the allowed direction so two nodes cannot swap
        way = F.col("new") < F.col("own") if rnd % 2 == 0 else F.col("new") > F.col("own")
        go = ((F.col("stride") > 0) & way &
              (F.pmod(F.xxhash64("nid", F.lit(rnd), F.lit(seed)), F.col("stride")) == 0))
        if hold_targets:
            wish = cut_lineage(wish)
            left = wish.where(go).select("bin", F.col("own").alias("new"), F.lit(True).alias("left")).distinct()
            wish = wish.join(left, ["bin", "new"], "left")
            go = go & F.col("left").isNull()
        wishes = wish.select("bin", "nid", "new", go.alias("go"))
        if any(halving[b] > MAX_HALVINGS for b in active):
            wish = cut_lineage(wish)
            single = _apart(wish.where("stride = 0")).unionByName(
                wish.where("stride = -1").groupBy("bin")
                .agg(F.max(F.struct("rise", "nid", "new")).alias("m")).select("bin", "m.nid", "m.new"))
            wishes = (wish.join(single.select("bin", "nid", F.lit(True).alias("alone")), ["bin", "nid"], "left")
                      .select("bin", "nid", "new", (go | F.coalesce("alone", F.lit(False))).alias("go")))
        proposal = cut_lineage(
            member.join(wishes, ["bin", "nid"], "left")
            .select("bin", "nid", F.when(F.col("go"), F.col("new")).otherwise(F.col("comm")).alias("comm"), *extras,
                    F.coalesce("go", F.lit(False)).alias("moved"), F.col("new").isNotNull().alias("wants")))
        proposed = time.time()
        n_moved = proposal.groupBy("bin").agg(F.count_if("moved").alias("n"), F.count_if("wants").alias("open"))
        stats = objective(proposal.drop("moved", "wants")).join(n_moved, "bin", "left").collect()
        moved = {r["bin"]: r["n"] or 0 for r in stats}
        wanted = {r["bin"]: r["open"] or 0 for r in stats}
        new_obj = {r["bin"]: r["obj"] for r in stats}
        scored = time.time()
        accept, rejected, ended = [], [], []
        for b in active:
            if moved.get(b, 0) == 0:
                if halving[b] > MAX_HALVINGS or wanted.get(b, 0) == 0 or (halving[b] == 0 and nomove.get(b)):
                    ended.append(b)  # no node wants to move, in either direction
                elif halving[b] == 0:
                    nomove[b] = True
                else:
                    halving[b] = MAX_HALVINGS + 1  # the hashed subset held no mover
                continue
            nomove[b] = False
            if new_obj.get(b, float("-inf")) > obj[b] + EPS:
                accept.append(b)
                obj[b] = new_obj[b]
                if halving[b] != MAX_HALVINGS + 1:
                    halving[b] = max(0, halving[b] - 1)
            elif halving[b] > MAX_HALVINGS + 1:
                rejected.append(b)
                ended.append(b)      # the best move is within rounding of none
            else:
                rejected.append(b)
                halving[b] += 1
        active = [b for b in active if b not in ended]
        if log is not None:
            log.append({"round": rnd, "accepted": len(accept), "active": len(active)})
        if VERBOSE:
            print(f"round {rnd} active={len(active)} accepted={len(accept)} "
                  f"moved={sum(moved.values())} obj={sum(obj.values()):.6f} "
                  f"t_prop={proposed - started:.1f} t_stats={scored - proposed:.1f}", flush=True)
        before = member
        if accept and not rejected:
            member = proposal.drop("moved", "wants")
            member._citeweave_path = proposal.__dict__.pop("_citeweave_path")
            release(before)
        elif accept:
            acc = small_table(spark, [(b,) for b in accept], "bin bigint")
            newer = proposal.join(F.broadcast(acc), "bin", "left_semi").drop("moved", "wants")
            older = member.join(F.broadcast(acc), "bin", "left_anti")
            member = cut_lineage(newer.unionByName(older))
            release(before, proposal)
        else:
            release(proposal)
    return member


def _apart(wish: DataFrame) -> DataFrame:
    """(bin, nid, new): the wishes that are the best of both communities they touch."""
    best = (wish.select("bin", F.explode(F.array("own", "new")).alias("c"), "rise", "nid")
            .groupBy("bin", "c").agg(F.max(F.struct("rise", "nid")).alias("m"))
            .select("bin", "c", F.col("m.nid").alias("top")))
    old, new = (best.select("bin", F.col("c").alias(name), F.col("top").alias(f"top_{name}"))
                for name in ("own", "new"))
    return (wish.join(old, ["bin", "own"]).join(new, ["bin", "new"])
            .where("nid = top_own AND nid = top_new").select("bin", "nid", "new"))


def aggregate_graph(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Collapse communities to nodes: (bin, src, dst, w) summed between
    communities; intra-community weight becomes a self-loop."""
    ms = member.select("bin", F.col("nid").alias("src"), F.col("comm").alias("cs"))
    md = member.select("bin", F.col("nid").alias("dst"), F.col("comm").alias("cd"))
    return (edges.join(ms, ["bin", "src"]).join(md, ["bin", "dst"])
            .groupBy("bin", F.col("cs").alias("src"), F.col("cd").alias("dst"))
            .agg(F.sum("w").alias("w")))


def compose(base: DataFrame, level: DataFrame) -> DataFrame:
    """Original node -> level node -> level community."""
    lv = level.select("bin", F.col("nid").alias("comm"), F.col("comm").alias("_c"))
    return base.join(lv, ["bin", "comm"]).select("bin", "nid", F.col("_c").alias("comm"))


def connected_parts(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Split every community into its weakly connected parts (along edges
    inside the community).  Label propagation of the smallest node id with
    pointer jumping; the new community id is the part's smallest node id."""
    ms = member.select("bin", F.col("nid").alias("src"), F.col("comm").alias("cs"))
    md = member.select("bin", F.col("nid").alias("dst"), F.col("comm").alias("cd"))
    intra = (edges.where(F.col("src") != F.col("dst"))
             .join(ms, ["bin", "src"]).join(md, ["bin", "dst"])
             .where(F.col("cs") == F.col("cd")).select("bin", "src", "dst"))
    und = cut_lineage(intra.union(intra.select("bin", F.col("dst").alias("src"),
                                                F.col("src").alias("dst"))).distinct())
    label = cut_lineage(member.select("bin", "nid", F.col("nid").alias("lab")))
    while True:
        nb = (und.join(label.select("bin", F.col("nid").alias("dst"), F.col("lab").alias("l")),
                       ["bin", "dst"])
              .groupBy("bin", F.col("src").alias("nid")).agg(F.min("l").alias("l")))
        step = (label.join(nb, ["bin", "nid"], "left")
                .select("bin", "nid", F.least("lab", F.coalesce("l", "lab")).alias("lab")))
        # pointer jumping: adopt the label of one's label
        jump = (step.join(step.select("bin", F.col("nid").alias("lab"), F.col("lab").alias("l2")),
                          ["bin", "lab"], "left")
                .select("bin", "nid", F.least("lab", F.coalesce("l2", "lab")).alias("lab")))
        jump = cut_lineage(jump)
        changed = (jump.join(label.withColumnRenamed("lab", "old"), ["bin", "nid"])
                   .where(F.col("lab") != F.col("old")).limit(1).count())
        label = jump
        if changed == 0:
            break
    return label.select("bin", "nid", F.col("lab").alias("comm"))


def relabel(ids: DataFrame, member: DataFrame) -> DataFrame:
    """Final (bin, node, cluster): community ids 0..k-1 per bin ordered by
    size (descending) then smallest node id."""
    named = member.join(ids, ["bin", "nid"])
    comms = (named.groupBy("bin", "comm")
             .agg(F.count(F.lit(1)).alias("_size"), F.min("node").alias("_min")))
    ranked = dense_rank_ids(comms, ["bin", F.desc("_size"), "_min"], "cluster", per="bin")
    return (named.join(ranked.select("bin", "comm", "cluster"), ["bin", "comm"])
            .select("bin", "node", F.col("cluster").cast("bigint").alias("cluster")))

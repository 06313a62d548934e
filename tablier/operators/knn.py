"""Exact k nearest neighbours without all pairs (used by SMOTE, SMOTE-NC and k-NN).

Per group (class) a metric tree is grown over the distinct points, all groups
and nodes at once, one level a pass: a node of more than ``CELL_TARGET`` points
chooses a few of them as pivots and hands every point to the nearest one, until
each leaf is small. Equal points are folded into one before, with the smallest
``k + 1`` of their keys, so no number of copies makes a leaf large. Nodes carry
their pivot as centre, the largest distances of their queries and members to
it, and their number of members.

A leaf first searches itself, which bounds its k-th distances (a leaf with too
few members takes the bound of its closest large enough ancestor). It then
descends the tree from the root and keeps the nodes that may hold something
closer: distance of the centres minus both radii within the bound. Neighbouring
leaves ask together, as a bundle: a leaf that any of them reached travels to the
bundle once, nearest bound first, and meets the leaves that asked for it. There
are about ``BUNDLES`` bundles, and more only where one would hold more than
``BUNDLE_QUERIES`` queries, so that what is moved grows with the points and not
with the pairs of leaves. Distances are matrix products of blocks; what may
count is measured again exactly. A task holds the queries of a bundle and one
leaf. The result is exact, ties by neighbour key.

Where the data have structure a leaf meets few others; for points without any
(dozens of independent dimensions) the bound excludes little. The share of leaf
pairs that were compared is logged.

Distances may carry a nominal part (SMOTE-NC): each differing nominal value
adds ``nominal_penalty`` to the squared distance, which is still a metric.
Rows whose vector is null or holds null or NaN take no part.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import BROADCAST_MAX_ROWS, stratum_col
from .running import in_order, written

CELL_TARGET = 2_000  # distinct points of a leaf
PIVOTS = 64  # children of a node
ROWS_PER_TASK = 50_000  # points of one node that a task hands to its pivots
PACKET_BYTES = 8_192  # coordinates that travel as one row between leaves
BUNDLES = 64  # of asking leaves; a leaf travels to each of them at most once
BUNDLE_QUERIES = 20_000  # asking points that a task holds, and as many more as a leaf has
BUNDLE_LEAST = 500  # asking points that are worth a bundle
_SLACK = 1e-9  # relative allowance for rounding in bounds

_log = logging.getLogger(__name__)
_POINT = "_g string, _h1 long, _h2 long, _v array<double>, _cat array<string>, _isq boolean, _keys array<string>, _node string"


def _vector(df: DataFrame, features) -> DataFrame:
    raw = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    return df.withColumn("_v", F.transform(raw, lambda x: x + 0.0))  # no negative zeros


def _penalty_of(penalty: dict[str, float]) -> Column:
    """The nominal penalty of the group ``_g``."""
    given = [(g, float(p)) for g, p in penalty.items() if p]
    if not given:
        return F.lit(0.0)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in given for x in pair]), F.col("_g")), F.lit(0.0))


def _apart(a: str, b: str) -> str:
    """SQL distance of the points (``{a}_v``, ``{a}_cat``) and (``{b}_v``, ``{b}_cat``)."""
    square = f"aggregate(zip_with({a}_v, {b}_v, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"
    differing = f"aggregate(zip_with({a}_cat, {b}_cat, (x, y) -> if(x <=> y, 0D, 1D)), 0D, (s, x) -> s + x)"
    return f"sqrt({square} + _pen * {differing})"


def fold_points(base: DataFrame, k: int) -> DataFrame:
    """Distinct points (_g, _h1, _h2, _v, _cat, _isq, _keys): the k + 1 smallest member keys of each."""
    point = ["_g", "_h1", "_h2"]
    smallest = W.partitionBy(*point).orderBy("_q")
    first = base.where("_ism").select(*point, "_q").withColumn("_r", F.row_number().over(smallest)).where(F.col("_r") <= k + 1)
    keys = first.groupBy(*point).agg(F.sort_array(F.collect_list("_q")).alias("_keys"))
    points = base.groupBy(*point).agg(F.first("_v").alias("_v"), F.first("_cat").alias("_cat"), F.max("_isq").alias("_isq"))
    empty = F.array().cast("array<string>")
    return points.join(keys, point, "left").withColumn("_keys", F.coalesce("_keys", empty)).withColumn("_node", F.lit(""))


def _hand_out(penalty: dict[str, float]):
    """Points to the nearest pivot of their node; each stretch of points follows its node's pivots."""

    def run(batches):
        import numpy as np
        import pandas as pd

        pivots = cats = None
        for pdf in batches:
            made = []
            # a header row starts the stretch of its node
            stretch = (pdf["_role"] == 0).cumsum().to_numpy()
            for s in np.unique(stretch):
                part = pdf[stretch == s]
                if part["_role"].iloc[0] == 0:
                    head, part = part.iloc[0], part.iloc[1:]
                    pivots = np.array([list(p) for p in head["_pv"]], float)
                    cats = np.array([list(c) for c in head["_pc"]], dtype=object).reshape(len(pivots), -1)
                if part.empty:
                    continue
                x = np.array(part["_v"].tolist(), float)
                d2 = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
                if cats.shape[1]:
                    own = np.array(part["_cat"].tolist(), dtype=object).reshape(len(part), -1)
                    d2 = d2 + (own[:, None, :] != cats[None, :, :]).sum(axis=2) * penalty.get(part["_g"].iloc[0], 0.0)
                child = d2.argmin(axis=1)
                out = part[["_g", "_h1", "_h2", "_v", "_cat", "_isq", "_keys"]].copy()
                out["_node"] = [f"{n}{c:02d}" for n, c in zip(part["_node"], child)]
                made.append(out)
            if made:
                yield pd.concat(made, ignore_index=True)

    return run


def grow(points: DataFrame, penalty: dict[str, float], seed: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Points with their leaf ``_node``, the tree's nodes (none if no group was split) and its depth.

    A node is named by the pivots taken on the way, two digits each.
    """
    pen = _penalty_of(penalty)
    nodes, level, settled = None, 0, None
    current = points
    while True:
        sizes = current.groupBy("_g", "_node").agg(F.count("*").alias("_n"))
        big = written(sizes.where(F.col("_n") > CELL_TARGET), "knn-big")
        n_big = big.count()
        if not n_big:
            return (current if settled is None else settled.unionByName(current)), nodes, level
        hint = F.broadcast if n_big <= BROADCAST_MAX_ROWS else (lambda df: df)
        marked = current.join(hint(big), ["_g", "_node"], "left")
        small = marked.where("_n IS NULL").drop("_n")
        settled = small if settled is None else settled.unionByName(small)
        large = marked.where("_n IS NOT NULL")
        place = W.partitionBy("_g", "_node").orderBy(F.xxhash64("_h1", "_h2", F.lit(seed + level)), "_h1", "_h2")
        wanted = F.least(F.lit(PIVOTS), F.ceil(2 * F.col("_n") / CELL_TARGET) + 1)
        chosen = large.withColumn("_r", F.row_number().over(place)).where((F.col("_r") <= PIVOTS) & (F.col("_r") <= wanted))
        pivots = written(chosen.select("_g", "_node", "_r", "_v", "_cat", "_n"), "knn-pivots")
        tasks = F.ceil(F.col("_n") / ROWS_PER_TASK)
        heads = pivots.groupBy("_g", "_node", "_n").agg(F.sort_array(F.collect_list(F.struct("_r", "_v", "_cat"))).alias("_p"))
        heads = heads.select(
            "_g", "_node", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("_task"), F.lit(0).alias("_role"),
            F.col("_p._v").alias("_pv"), F.col("_p._cat").alias("_pc"),
            F.lit(0).cast("long").alias("_h1"), F.lit(0).cast("long").alias("_h2"),  # no nulls, so that long ids stay whole
        )
        rows = large.withColumn("_task", F.pmod(F.col("_h1"), tasks)).withColumn("_role", F.lit(1)).drop("_n")
        stream = rows.unionByName(heads, allowMissingColumns=True).repartition("_g", "_node", "_task")
        handed = stream.sortWithinPartitions("_g", "_node", "_task", "_role").mapInPandas(_hand_out(penalty), _POINT)
        current = written(handed, "knn-points")
        # the new nodes: centre, radii of queries and members, members with their copies
        centres = pivots.select(
            "_g", F.col("_node").alias("_parent"), F.concat("_node", F.lpad((F.col("_r") - 1).cast("string"), 2, "0")).alias("_node"),
            F.col("_v").alias("c_v"), F.col("_cat").alias("c_cat"),
        )
        hint = F.broadcast if n_big * PIVOTS <= BROADCAST_MAX_ROWS // 16 else (lambda df: df)
        far = current.join(hint(centres), ["_g", "_node"]).withColumn("_pen", pen).withColumn("_d", F.expr(_apart("", "c")))
        stats = far.groupBy("_g", "_node").agg(
            F.max(F.when(F.col("_isq"), F.col("_d"))).alias("_rq"), F.max(F.when(F.size("_keys") > 0, F.col("_d"))).alias("_rm"),
            F.sum(F.size("_keys")).alias("_members"),
        )
        made = written(centres.join(stats, ["_g", "_node"]).withColumn("_level", F.lit(level + 1)), "knn-nodes")
        nodes = made if nodes is None else nodes.unionByName(made)
        level += 1


# ------------------------------------------------------------------ leaves in a task


class _Leaf:
    """The points of a leaf as arrays; ``entries`` are its members, one per key."""

    def __init__(self, vectors, cats, keys, asks, ids):
        import numpy as np

        self.ids = [i for i, a in zip(ids, asks) if a]
        asks = np.array(asks, bool)
        self.q, self.qc = vectors[asks], cats[asks]
        copies = np.array([len(k) for k in keys], int)
        self.m, self.mc = np.repeat(vectors, copies, axis=0), np.repeat(cats, copies, axis=0)
        self.mk = np.array([x for k in keys for x in k], dtype=object)


def _closest(queries: _Leaf, members: _Leaf, best: list[list[tuple]], k: int, pen: float) -> None:
    """Merge ``members`` into the k best (distance, key) of each query."""
    import numpy as np

    if not len(queries.q) or not len(members.m):
        return
    qq, mm = (queries.q**2).sum(1), (members.m**2).sum(1)
    for at in range(0, len(queries.q), 512):
        q, qc = queries.q[at : at + 512], queries.qc[at : at + 512]
        d2 = qq[at : at + 512, None] + mm[None, :] - 2 * q @ members.m.T
        if qc.shape[1]:
            d2 = d2 + (qc[:, None, :] != members.mc[None, :, :]).sum(axis=2) * pen
        slack = 1e-11 * (qq[at : at + 512] + mm.max()) + 1e-300
        limit = np.array([b[k - 1][0] ** 2 if len(b) >= k else np.inf for b in best[at : at + 512]])
        if d2.shape[1] > k:
            limit = np.minimum(limit, np.partition(d2, k - 1, axis=1)[:, k - 1] + slack)
        near = d2 <= (limit + slack)[:, None]
        for i in np.flatnonzero(near.any(axis=1)):
            idx = np.flatnonzero(near[i])
            exact = ((q[i] - members.m[idx]) ** 2).sum(axis=1)
            if qc.shape[1]:
                exact = exact + (qc[i] != members.mc[idx]).sum(axis=1) * pen
            found = zip(np.sqrt(exact).tolist(), members.mk[idx].tolist())
            best[at + i] = sorted([*best[at + i], *found])[:k]


def _rows_of(pdf):
    """(vectors, nominal values, keys, asks, ids) of the points in a frame."""
    import numpy as np

    cats = np.array(pdf["_cat"].tolist(), dtype=object).reshape(len(pdf), -1)
    return np.array(pdf["_v"].tolist(), float), cats, pdf["_keys"].tolist(), pdf["_isq"].tolist(), list(zip(pdf["_h1"], pdf["_h2"]))


def _pack(k: int, penalty: dict[str, float]):
    """Packets of a leaf's points, and the largest k-th distance of its queries within it."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        g, leaf = pdf["_g"].iloc[0], pdf["_node"].iloc[0]
        vectors, cats, keys, asks, ids = _rows_of(pdf)
        own = _Leaf(vectors, cats, keys, asks, ids)
        best: list[list[tuple]] = [[] for _ in own.ids]
        _closest(own, own, best, k, penalty.get(g, 0.0))
        bound = max((b[k - 1][0] if len(b) >= k else np.inf for b in best), default=-1.0)
        step = max(1, PACKET_BYTES // (8 * max(1, vectors.shape[1])))
        out = []
        for at in range(0, len(pdf), step):
            part = slice(at, at + step)
            out.append((g, leaf, bound, vectors[part].astype("<f8").tobytes(), vectors.shape[1], [list(c) for c in cats[part]], [list(x) for x in keys[part]],
                        list(asks[part]), [int(i[0]) for i in ids[part]], [int(i[1]) for i in ids[part]]))
        return pd.DataFrame(out, columns=["_g", "_leaf", "_bound", "_bytes", "_dim", "_cats", "_allkeys", "_asks", "_h1s", "_h2s"])

    return run


_PACKET = (
    "_g string, _leaf string, _bound double, _bytes binary, _dim int, _cats array<array<string>>, _allkeys array<array<string>>, "
    "_asks array<boolean>, _h1s array<long>, _h2s array<long>"
)


def _unpack(packets: list) -> _Leaf:
    import numpy as np

    vectors = np.concatenate([np.frombuffer(p["_bytes"], "<f8").reshape(-1, p["_dim"]) for p in packets])
    cats = np.array([list(c) for p in packets for c in p["_cats"]], dtype=object).reshape(len(vectors), -1)
    keys = [list(x) for p in packets for x in p["_allkeys"]]
    asks = [a for p in packets for a in p["_asks"]]
    ids = [i for p in packets for i in zip(p["_h1s"], p["_h2s"])]
    return _Leaf(vectors, cats, keys, asks, ids)


def _search(k: int, penalty: dict[str, float]):
    """Per asking point its k best; a bundle's own leaves come first, then other leaves by rising bound."""

    def run(batches):
        import pandas as pd

        bundle, at, packets, asking = None, None, [], {}

        def take():
            """Use the packets of one leaf; of an own leaf its queries stay."""
            if not packets:
                return
            leaf, pen = _unpack(packets), penalty.get(bundle[0], 0.0)
            if packets[0]["_far"] == float("-inf"):
                asking[packets[0]["_leaf"]] = leaf, [[] for _ in leaf.ids]
            for name in packets[0]["_askers"]:
                _closest(asking[name][0], leaf, asking[name][1], k, pen)
            if packets[0]["_far"] == float("-inf"):
                leaf.m = leaf.mc = leaf.mk = None
            packets.clear()

        def results():
            take()
            for leaf, found in asking.values():
                rows = [(bundle[0], a, b, [x[1] for x in best], [x[0] for x in best]) for (a, b), best in zip(leaf.ids, found)]
                yield pd.DataFrame(rows, columns=["_g", "_h1", "_h2", "_nk", "_nd"])
            asking.clear()

        for pdf in batches:
            for row in pdf.to_dict("records"):
                if (row["_g"], row["_bundle"]) != bundle:
                    yield from results()
                    bundle, at = (row["_g"], row["_bundle"]), None
                if (row["_far"], row["_leaf"]) != at:
                    take()
                    at = row["_far"], row["_leaf"]
                packets.append(row)
        yield from results()

    return run


def bundled(leaves: DataFrame) -> tuple[DataFrame, int]:
    """(_g, _asker, _bundle) of the leaves with queries, neighbours in the tree together, and about how many bundles there are."""
    asking = written(leaves.where("_asked > 0").select("_g", F.col("_leaf").alias("_asker"), "_asked"), "knn-asking")
    total = asking.agg(F.sum("_asked")).first()[0] or 0
    size = min(BUNDLE_QUERIES, max(BUNDLE_LEAST, -(-total // BUNDLES)))
    # siblings have a common beginning of their names
    placed = in_order(asking, ["_g"], ["_asker"], sums=["_asked"])
    made = placed.select("_g", "_asker", F.floor(F.col("_asked_below") / size).alias("_bundle"))
    return written(made, "knn-bundles"), -(-total // size)


def leaf_pairs(leaves: DataFrame, nodes: DataFrame, depth: int, penalty: dict[str, float], k: int) -> DataFrame:
    """(_g, _asker, _leaf, _far): for each asking leaf the other leaves that may hold closer points.

    ``leaves`` has (_g, _leaf, _bound); all leaves descend the tree together.
    """
    pen = _penalty_of(penalty)
    ends = leaves.join(nodes, (leaves["_leaf"] == nodes["_node"]) & (leaves["_g"] == nodes["_g"])).select(
        leaves["_g"], "_leaf", "_bound", F.col("c_v").alias("q_v"), F.col("c_cat").alias("q_cat"), F.col("_rq").alias("q_r")
    )
    asking = ends.where("q_r IS NOT NULL")
    # too few members in the leaf: all of an ancestor's members lie within the sum of its radii
    above = asking.where(F.col("_bound") == float("inf")).select(
        "_g", "_leaf", F.explode(F.expr("transform(sequence(1, length(_leaf) div 2), i -> substring(_leaf, 1, 2 * i))")).alias("_node")
    )
    reach = above.join(nodes.where(F.col("_members") >= k), ["_g", "_node"]).groupBy("_g", "_leaf").agg(F.min(F.col("_rq") + F.col("_rm")).alias("_reach"))
    asking = asking.join(reach, ["_g", "_leaf"], "left").withColumn("_bound", F.least("_bound", F.coalesce("_reach", F.lit(float("inf"))))).drop("_reach")
    asking = asking.withColumnRenamed("_leaf", "_asker")
    final = leaves.select("_g", F.col("_leaf").alias("_node"), F.lit(True).alias("_end"))
    nodes = nodes.where(F.col("_rm").isNotNull()).join(final, ["_g", "_node"], "left")
    front, found = asking.withColumn("_parent", F.lit("")), None
    for level in range(1, depth + 1):
        opened = front.join(nodes.where(F.col("_level") == level), ["_g", "_parent"]).withColumn("_pen", pen)
        far = F.expr(_apart("q", "c")) * (1 - _SLACK) - F.col("q_r") - F.col("_rm")
        near = opened.withColumn("_far", far).where(F.col("_far") <= F.col("_bound") * (1 + _SLACK))
        # the centre of the asking leaf is needed further down only
        down = [F.when(F.col("_end").isNull(), F.col(c)).alias(c) for c in ("q_v", "q_cat")]
        kept = written(near.select("_g", "_asker", "_bound", *down, "q_r", "_node", "_end", "_far"), "knn-front")
        hits = kept.where("_end AND _node <> _asker").select("_g", "_asker", F.col("_node").alias("_leaf"), "_far")
        found = hits if found is None else found.unionByName(hits)
        front = kept.where("_end IS NULL").select(*asking.columns, F.col("_node").alias("_parent"))
    return written(found, "knn-pairs")


def knn_within_groups(df: DataFrame, key: str, group, features, k: int, seed: int = 42,
                      nominal: list[str] | None = None, nominal_penalty: dict[str, float] | None = None,
                      query=None, member=None) -> DataFrame:
    """(group, key, neighbour key, distance, rank) for the k nearest *other* rows of the same group.

    ``query`` / ``member`` (boolean columns, default all rows) restrict which
    rows ask for neighbours and which rows may be neighbours (k-NN scoring:
    queries = rows to score, members = training rows).
    """
    nominal, penalty = list(nominal or []), {g: float(p) for g, p in (nominal_penalty or {}).items()}
    cat = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in nominal]) if nominal else F.array().cast("array<string>")
    base = _vector(df, features).select(
        stratum_col(group).alias("_g"), F.col(key).cast("string").alias("_q"), "_v", cat.alias("_cat"),
        (query if query is not None else F.lit(True)).alias("_isq"), (member if member is not None else F.lit(True)).alias("_ism"),
    )
    base = base.where(F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x)))
    base = written(base.withColumn("_h1", F.xxhash64(F.lit(1), "_v", "_cat")).withColumn("_h2", F.xxhash64(F.lit(2), "_v", "_cat")), "knn-rows")
    wanted = k + 1  # a row may find itself
    points, nodes, depth = grow(written(fold_points(base, k), "knn-points"), penalty, seed)
    packets = points.groupBy("_g", "_node").applyInPandas(_pack(wanted, penalty), _PACKET)
    itself = [F.lit(float("-inf")).alias("_far"), F.array("_leaf").alias("_askers")]
    if nodes is None:
        dealt = packets.select("*", F.lit(0).cast("long").alias("_bundle"), *itself).repartition("_g", "_bundle")
    else:
        packets = written(packets, "knn-packets")
        leaves = packets.groupBy("_g", "_leaf").agg(
            F.first("_bound").alias("_bound"), F.sum(F.size(F.filter("_asks", lambda x: x))).alias("_asked")
        )
        pairs = leaf_pairs(leaves.drop("_asked"), nodes, depth, penalty, wanted)
        sizes = leaves.groupBy("_g").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1))).first()
        _log.info("k-NN: %d leaves, %d of %d leaf pairs compared", sizes[0], pairs.count(), sizes[1])
        bundles, number = bundled(leaves)
        own = bundles.select("_g", F.col("_asker").alias("_leaf"), "_bundle", F.lit(float("-inf")).alias("_far"), F.array("_asker").alias("_askers"))
        asked = pairs.join(bundles, ["_g", "_asker"]).groupBy("_g", "_leaf", "_bundle").agg(
            F.min("_far").alias("_far"), F.collect_list("_asker").alias("_askers")
        )
        trips = written(own.unionByName(asked), "knn-trips")
        dealt = packets.join(trips, ["_g", "_leaf"]).repartition(max(1, 2 * number), "_g", "_bundle")
    dealt = dealt.sortWithinPartitions("_g", "_bundle", "_far", "_leaf")
    found = dealt.mapInPandas(_search(wanted, penalty), "_g string, _h1 long, _h2 long, _nk array<string>, _nd array<double>")
    asked = base.where("_isq").select("_g", "_q", "_h1", "_h2").join(found, ["_g", "_h1", "_h2"])
    others = F.slice(F.filter(F.arrays_zip("_nk", "_nd"), lambda x: x["_nk"] != F.col("_q")), 1, k)
    return asked.select("_g", "_q", F.posexplode(others).alias("_i", "_x")).select(
        F.col("_g").alias("group"), F.col("_q").alias("key"), F.col("_x._nk").alias("nn_key"), F.col("_x._nd").alias("distance"),
        (F.col("_i") + 1).alias("nn_rank"),
    )

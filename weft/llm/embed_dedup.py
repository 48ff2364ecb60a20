"""Operator 7: near-duplicate vectors by NN-descent.

Only vectors with equal labels are compared. Equal vectors of a label are one node with a weight.
The first neighbour graph comes from random orders: in each of ``ORDERS`` orders (by random
hyperplane bits, then a random projection) every node takes its nearest nodes within a block of
consecutive nodes; a hot label or thousands of near copies are just more blocks. Then rounds of
NN-descent: the members of each neighbourhood (neighbours and nodes that have it as neighbour) are
compared with each other and improve their lists. Threshold edges join components for good, and
every node lists its nearest nodes of its own component and of other components apart: what is
searched for is links between components, and near copies take no place from them. Rounds end when
one finds no new link (at most ``ROUNDS``).

Then every label is audited: up to ``AUDIT`` nodes that stand for a component (or have no link) and
as many other members are compared with the whole label in blocks. A node is whole if all its true
links stay in its component. The links that the audit finds are kept, so a label of up to ``AUDIT``
nodes is exact. In a larger label ``TARGET_RECALL`` of the audited nodes with links must be whole,
and there must be ``ENOUGH`` of them; a label that does not show this (also one with next to no
links) is compared whole, in blocks, which is exact and grows with the square of the label.

Threshold edges give components. Links are counted inside the components by comparing blocks of
at most ``BLOCK`` nodes with each other, without emitting pairs, so the lists' length limits no
count. Linked vectors have a cosine of at least the threshold in double precision.

Defined results: one row per input row. Vectors that are null, zero, hold null or non-finite
components, or have another length than most, and rows without a label, link with nothing: 0
links, own component, kept. component_id is the smallest non-null vec_id of the component; kept is
vec_id = component_id, and false for a null vec_id. Repeated rows link with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm import vectors as V
from weft.llm.graph import components
from weft.llm.scratch import materialise
from weft.llm.stream import whole_groups

K = 8
ORDERS = 6
RUN = 64
ROUNDS = 5
MIN_ROUNDS = 2
AUDIT = 1024
ENOUGH = 100
TARGET_RECALL = 0.99
BLOCK = 1024
WIDE = 16384
SLICE = 512
_EPS = 1e-9


def _best(v: np.ndarray, u: np.ndarray, s: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64()), pa.array(s, pa.float64())], ["v", "u", "s"])


def _top(sims: np.ndarray, node: np.ndarray, k: int):
    """Each row's k best columns (-2 marks pairs that are not compared)."""
    k = min(k, sims.shape[1])
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    s = np.take_along_axis(sims, at, axis=1)
    ok = s > -2
    return np.repeat(node, k)[ok.ravel()], node[at].ravel()[ok.ravel()], s.ravel()[ok.ravel()]


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells ``(i, j)`` of a boolean matrix that connect every row and column that ``near`` connects."""
    rows, cols, turned = near.any(axis=1), near.any(axis=0), np.ascontiguousarray(near.T)
    out: list[tuple[int, int]] = []
    for start in np.flatnonzero(rows):
        todo = [start] if rows[start] else []
        rows[start] = False
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & cols)
            cols[new] = False
            for j in new:
                more = np.flatnonzero(turned[j] & rows)
                rows[more] = False
                out.append((i, j))
                out += [(m, j) for m in more]
                todo += more.tolist()
    return tuple(np.array(out, np.int64).reshape(-1, 2).T)


def _offers(s: np.ndarray, node: np.ndarray, k: int, threshold: float):
    """What a block of compared nodes tells: each row's k best columns, and sure threshold pairs
    that connect all that the block's threshold pairs connect, however many nearer ones there are."""
    i, j = _forest(s >= threshold + _EPS)
    v, u, x = _top(s, node, k)
    both = [np.concatenate(c) for c in ((v, node[i], node[j]), (u, node[j], node[i]), (x, s[i, j], s[i, j]))]
    return tuple(both)


def _first_graph(nodes: DataFrame, width: int, k: int, orders: int, threshold: float, seed: int = 11) -> DataFrame:
    """Neighbours of other components within blocks of consecutive nodes in random orders."""
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(orders, 13, width))
    send = nodes.sparkSession.sparkContext.broadcast(planes)

    def place(batches):
        for batch in batches:
            x = V.unit(V.matrix(batch.column(2), width))
            for t, p in enumerate(send.value):
                side = x @ p.T
                code = ((side[:, :12] > 0) * (1 << np.arange(12))).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t), pa.int32()), pa.array(code, pa.int32()), pa.array(side[:, 12], pa.float64()), *batch.columns],
                    ["t", "code", "proj", "node", "label", "vec", "comp"])

    placed = nodes.select("node", "label", "vec", "comp").mapInArrow(
        place, f"t int, code int, proj double, node long, label string, vec {dict(nodes.dtypes)['vec']}, comp long")
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = placed.repartitionByRange(parts, "t", "label", "code", "proj", "node").sortWithinPartitions("t", "label", "code", "proj", "node")

    def compare(batches):
        for batch in batches:
            t, node, label = batch.column(0).to_numpy(), batch.column(3).to_numpy(), batch.column(4).dictionary_encode().indices.to_numpy()
            x, comp = V.unit(V.matrix(batch.column(5), width)), batch.column(6).to_numpy()
            out = []
            for at in range(0, len(x), RUN // 2):  # half-overlapping runs
                e = slice(at, at + RUN)
                s = x[e] @ x[e].T
                s[(label[e][:, None] != label[e][None, :]) | (t[e][:, None] != t[e][None, :]) | (comp[e][:, None] == comp[e][None, :])] = -2
                out.append(_offers(s, node[e], k, threshold))
            if out:
                yield _best(*(np.concatenate(c) for c in zip(*out, strict=True)))

    return runs.mapInArrow(compare, "v long, u long, s double")


def _lists(graph: DataFrame, comps: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of each node in its own component and the k best in others, which
    near copies of the node therefore cannot crowd out: ``(v, u, s, same)``."""
    side = comps.select(F.col("node").alias("v"), F.col("comp").alias("_a"))
    other = comps.select(F.col("node").alias("u"), F.col("comp").alias("_b"))
    rows = graph.groupBy("v", "u").agg(F.max("s").alias("s")).join(side, "v", "left").join(other, "u", "left").select(
        "v", "u", "s", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("same"))
    rank = F.row_number().over(Window.partitionBy("v", "same").orderBy(F.desc("s"), "u"))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def _improve(graph: DataFrame, nodes: DataFrame, width: int, k: int, step: int, threshold: float) -> DataFrame:
    """Compares the members of every neighbourhood with each other; better neighbours in other
    components only."""
    kth = graph.filter(~F.col("same")).groupBy("v").agg(F.min("s").alias("worst"), F.count(F.lit(1)).alias("_n")).select(
        F.col("v").alias("node"), F.when(F.col("_n") >= k, F.col("worst")).alias("worst"))
    forward = graph.select(F.col("v").alias("c"), F.col("u").alias("node"))
    back = graph.select(F.col("u").alias("c"), F.col("v").alias("node"))
    # of the many that may have a node as neighbour, each round looks at another random few
    turn = F.row_number().over(Window.partitionBy("c").orderBy(F.xxhash64("node", "c", F.lit(step))))
    back = back.withColumn("_r", turn).filter(F.col("_r") <= 2 * k).drop("_r")
    members = forward.unionByName(back).unionByName(nodes.select(F.col("node").alias("c"), "node")).distinct()
    rows = members.join(nodes.select("node", "comp", "vec"), "node").join(kth, "node", "left").select(
        "c", "node", "comp", F.coalesce("worst", F.lit(-1.0)).alias("worst"), "vec")
    rows = rows.repartition("c").sortWithinPartitions("c")

    def compare(batches):
        for t, edge in whole_groups(batches, "c"):
            node, comp, worst, x = t.column("node").to_numpy(), t.column("comp").to_numpy(), t.column("worst").to_numpy(), V.unit(V.matrix(t.column("vec"), width))
            out = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                s = x[a:b] @ x[a:b].T
                s[(comp[a:b][:, None] == comp[a:b][None, :]) | ((s <= worst[a:b][:, None]) & (s < threshold))] = -2
                out.append(_offers(s, node[a:b], 4, threshold))
            yield _best(*(np.concatenate(col) for col in zip(*out, strict=True)))

    return rows.mapInArrow(compare, "v long, u long, s double")


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(node, comp)`` of the nodes with a link, when ``links(v, u)`` join the components so far."""
    edges = links.select("u", "v")
    if comps is not None:
        edges = edges.unionByName(comps.select(F.col("node").alias("u"), F.col("comp").alias("v")))
    return components(edges).withColumnRenamed("label", "comp")


def _with_comp(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """The nodes with their component; a node without links is its own."""
    return nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _joining(pairs: zip) -> list[bool]:
    """Which of the pairs of components join what the pairs before left apart."""
    above: dict[int, int] = {}

    def root(c: int) -> int:
        while c in above:
            up = above[c]
            above[c] = above.get(up, up)
            c = up
        return c

    out = []
    for a, b in pairs:
        a, b = root(a), root(b)
        out.append(a != b)
        if a != b:
            above[a] = b
    return out


def _near(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` are linked, decided in double precision."""
    s = V.unit(a) @ V.unit(b).T
    i, j = np.nonzero(np.abs(s - threshold) < _EPS)  # too near to trust the matrix product
    s[i, j] = V.cosines(a[i], b[j])
    return s >= threshold


def _sampled(nodes: DataFrame, sample: int) -> tuple[DataFrame, DataFrame]:
    """The nodes with ``first`` (stands for its component, alone or not) and ``left`` (audited), and
    the number of nodes by label and ``first``. Both kinds are sampled by themselves, so a large
    group counts once among the components; up to ``sample`` nodes of a kind are all audited."""
    nodes = nodes.withColumn("first", F.col("node") == F.col("comp"))
    sizes = nodes.groupBy("label", "first").agg(F.count(F.lit(1)).alias("n"))
    place = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 20))
    return nodes.join(sizes, ["label", "first"]).withColumn("left", place * F.col("n") < F.lit(sample << 20)).drop("n"), sizes


def _compare(rows: DataFrame, width: int, threshold: float) -> DataFrame:
    """Compares the rows marked ``left`` with all rows of their label, by pairs of blocks of about
    ``WIDE`` nodes. ``(v, u, whole)``: links that join all components with a link between them, and
    for every left node with links one row of each block, u null, whole if all stay in its component."""
    blocks = F.ceil(F.count(F.lit(1)) / WIDE).cast("int")
    sizes = rows.groupBy("label").agg(blocks.alias("_q"), F.ceil(F.count_if("left") / WIDE).cast("int").alias("_p")).filter("_p > 0")
    placed = rows.join(sizes, "label").select(
        "label", "node", "vec", "comp", "left", "_p", "_q", F.pmod(F.xxhash64("node", F.lit(4)), F.col("_p")).cast("int").alias("_a"),
        F.pmod(F.xxhash64("node", F.lit(3)), F.col("_q")).cast("int").alias("_b"))
    right = F.transform(F.sequence(F.lit(0), F.col("_p") - 1), lambda j: F.struct(F.lit(1).alias("side"), j.alias("a"), F.col("_b").alias("b")))
    left = F.transform(F.sequence(F.lit(0), F.col("_q") - 1), lambda j: F.struct(F.lit(0).alias("side"), F.col("_a").alias("a"), j.alias("b")))
    cells = F.when(F.col("left"), F.concat(left, right)).otherwise(right)
    grid = placed.select("label", "node", "vec", "comp", F.explode(cells).alias("_cell")).select("label", "node", "vec", "comp", "_cell.*")

    def compare(cell: pa.Table) -> pa.Table:
        side, x = cell.column("side").to_numpy(), V.matrix(cell.column("vec"), width)
        node, comp = cell.column("node").to_numpy(), cell.column("comp").to_numpy()
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        linked, missed, pairs = np.zeros(len(p), bool), np.zeros(len(p), bool), []
        for at in range(0, len(p), SLICE):
            few = p[at:at + SLICE]
            near = _near(x[few], x[q], threshold) & (node[few][:, None] != node[q][None, :])
            linked[at:at + SLICE] = near.any(axis=1)
            near &= comp[few][:, None] != comp[q][None, :]
            missed[at:at + SLICE] = near.any(axis=1)
            i, j = _forest(near)
            pairs.append((few[i], q[j]))
        i, j = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*pairs, strict=True) if pairs else ((), ())))
        keep = np.array(_joining(zip(comp[i].tolist(), comp[j].tolist(), strict=True)), bool)
        v = np.concatenate([node[i[keep]], node[p[linked]]])
        u = pa.array(np.concatenate([node[j[keep]], np.zeros(linked.sum(), np.int64)]), pa.int64(), mask=np.arange(len(v)) >= keep.sum())
        whole = pa.array(np.concatenate([np.zeros(keep.sum(), bool), ~missed[linked]]))
        return pa.table({"v": pa.array(v, pa.int64()), "u": u, "whole": whole})

    return grid.groupBy("label", "a", "b").applyInArrow(compare, "v long, u long, whole boolean")


def _unproven(nodes: DataFrame, sizes: DataFrame, found: DataFrame, sample: int) -> DataFrame:
    """Labels whose audit does not show that the components are whole: of a kind of which only a
    part was audited, fewer than ``ENOUGH`` audited nodes have links, or too few of these are whole."""
    audited = found.filter("u is null").groupBy("v").agg(F.min("whole").alias("whole")).withColumnRenamed("v", "node")
    kinds = nodes.select("node", "label", "first").join(audited, "node").groupBy("label", "first").agg(
        F.count(F.lit(1)).alias("linked"), F.count_if("whole").alias("whole"))
    shown = (F.col("linked") >= ENOUGH) & (F.col("whole") >= TARGET_RECALL * F.col("linked"))
    return sizes.filter(F.col("n") > sample).join(kinds, ["label", "first"], "left").filter(
        ~F.coalesce(shown, F.lit(False))).select("label").distinct()


def _count_links(members: DataFrame, width: int, threshold: float) -> DataFrame:
    """``(node, links)``: weights of the linked nodes in the same component, by pairs of blocks."""
    sizes = members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_n"))
    placed = members.join(sizes, "comp").withColumn("_b", F.pmod(F.xxhash64("node", F.lit(3)), F.col("_n")).cast("int"))
    other = F.sequence(F.lit(0), F.col("_n") - 1)
    cells = F.concat(F.transform(other, lambda j: F.struct(F.lit(0).alias("side"), F.col("_b").alias("a"), j.alias("b"))),
                     F.transform(other, lambda j: F.struct(F.lit(1).alias("side"), j.alias("a"), F.col("_b").alias("b"))))
    grid = placed.select("comp", "node", "vec", "weight", F.explode(cells).alias("_cell")).select("comp", "node", "vec", "weight", "_cell.*")

    def count(cell: pa.Table) -> pa.Table:
        side = cell.column("side").to_numpy()
        x, node, weight = V.matrix(cell.column("vec"), width), cell.column("node").to_numpy(), cell.column("weight").to_numpy()
        p, q = side == 0, side == 1
        a, b = x[p], x[q]
        links = (_near(a, b, threshold) & (node[p][:, None] != node[q][None, :])) @ weight[q]
        return pa.table({"node": pa.array(node[p], pa.int64()), "links": pa.array(links, pa.int64())})

    return grid.groupBy("comp", "a", "b").applyInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame, threshold: float = 0.93, k: int = K) -> DataFrame:
    """``rows(vec_id, embedding, label)`` to ``(vec_id, n_links, component_id, kept)``."""
    rows = rows.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    width = V.common_length(rows, "embedding")
    fine = F.col("label").isNotNull() & V.usable(F.col("embedding")) & (F.size("embedding") == width)
    # equal vectors of a label are one node (0.0 added, as -0.0 equals 0.0)
    vec = F.transform("embedding", lambda x: x + F.lit(0.0))
    rows = rows.withColumn("node", F.when(fine, F.xxhash64("label", vec)))
    nodes = materialise(rows.filter("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("embedding").alias("vec"),
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("vec_id")), "vectors")

    graph = materialise(_first_graph(nodes.withColumn("comp", F.col("node")), width, k, ORDERS, threshold), "graph")
    comps = _joined(None, graph.filter(F.col("s") >= threshold + _EPS))
    # the same search again between the components: what near copies hide from each other in a list
    more = _first_graph(_with_comp(nodes, comps), width, k, ORDERS, threshold, seed=12)
    more = materialise(more, "graph")
    comps = _joined(comps, more.filter(F.col("s") >= threshold + _EPS))
    graph = materialise(_lists(graph.unionByName(more), comps, k), "graph")
    for step in range(ROUNDS):
        better = materialise(_improve(graph, _with_comp(nodes, comps), width, k, step, threshold), "better")
        links = better.filter(F.col("s") >= threshold + _EPS)
        if step + 1 >= MIN_ROUNDS and not links.head(1):
            break
        comps = _joined(comps, links)
        graph = materialise(_lists(graph.select("v", "u", "s").unionByName(better), comps, k), "graph")
    placed, sizes = _sampled(_with_comp(nodes, comps), AUDIT)
    found = materialise(_compare(placed, width, threshold), "audit")
    rest = materialise(_unproven(placed, sizes, found, AUDIT), "unproven")
    comps = _joined(comps, found.filter("u is not null"))
    if rest.head(1):
        whole = _with_comp(nodes, comps).join(rest, "label", "left_semi").withColumn("left", F.lit(True))
        found = materialise(_compare(whole, width, threshold), "compared")
        comps = _joined(comps, found.filter("u is not null"))
    members = comps.join(nodes, "node")
    least = members.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    classes = members.select("node", "comp").join(least, "comp").select("node", "component_id")
    links = _count_links(members, width, threshold)
    about = nodes.join(links, "node", "left").join(classes, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    out = rows.select("vec_id", "node").join(about, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

"""Near-duplicate embeddings through robust-pruned flat graphs on overlapping cluster shards.

Clusters are split again and again, in tasks, until they are small enough for a
graph, so their number grows with the table. Very dense groups never become a
shard: vectors so near a common centre that any two of them link, by the
triangle inequality of angles, form a ball, which is counted at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantflume.llm.common import Groups, components, cut_lineage

#: Vectors that a cluster is planned for; clusters that are home to over twice as many are split.
SHARD = 1024
#: A split must leave less than this share of a cluster's comparisons; rows of a cluster that a task assigns at once.
LEAST_GAIN, ASSIGN_ROWS = 0.75, 8192
#: Parts that a vector of the sample may go to on average; where they are more, the cluster isn't split.
MOST_PARTS = 2.0
#: Clusters that one is split into at most, and how often; shards in a cut by hash of what is still larger then.
FAN, LEVELS, CUT = 64, 8, 16
#: Vectors of a cluster that its parts' centres are fitted on, about.
FIT_ROWS = 4096
#: Graph: neighbours kept, nearest and random candidates looked at, and how much nearer a detour must be to prune.
DEGREE, NEAR, FAR, ALPHA = 24, 48, 16, 1.2
#: Search: beam, and how far below the asked similarity the range is still expanded.
BEAM, SLACK = 40, 0.06
#: The widest beam tried; where that finds too little, comparing all costs less.
WIDEST = 80
#: Queries of a shard that are audited against all its vectors, and the least recall.
AUDIT, LEAST_RECALL = 32, 0.98


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centres on the unit sphere; starts far apart, empty ones stay."""
    rng = np.random.default_rng(11)
    centres = x[[int(rng.integers(len(x)))]]
    for _ in range(k - 1):
        gap = np.maximum(1 - (x @ centres.T).max(axis=1), 0) + 1e-9
        centres = np.concatenate([centres, x[[int(rng.choice(len(x), p=gap / gap.sum()))]]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def robust_prune(x: np.ndarray, of: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours (rows padded by -1) of the nodes ``of`` out of their candidates ``pool``.

    The nearest candidate stays and removes those to which it is nearer, by the
    factor alpha, than the node is; and so on with the rest.
    """
    n, width = pool.shape
    out = np.full((n, degree), -1, dtype=np.int32)
    vec = x[pool]
    far = 1 - np.einsum("nwd,nd->nw", vec, x[of], optimize=True)
    far[(pool == of[:, None]) | (pool < 0)] = np.inf
    rows = np.arange(n)
    for k in range(min(degree, width)):
        best = far.argmin(axis=1)
        ok = np.isfinite(far[rows, best])
        if not ok.any():
            break
        out[ok, k] = pool[rows, best][ok]
        between = 1 - np.einsum("nwd,nd->nw", vec, vec[rows, best], optimize=True)
        far[alpha * between <= far] = np.inf
        far[rows, best] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, near: int = NEAR, more: int = FAR, alpha: float = ALPHA, block: int = 256) -> list[np.ndarray]:
    """A flat graph over unit vectors: pruned both ways, and every node reachable from the medoid."""
    n = len(x)
    rng = np.random.default_rng(n)
    links = np.empty((n, degree), dtype=np.int32)
    for a in range(0, n, block):
        of = np.arange(a, min(n, a + block))
        sims = x[of] @ x.T
        sims[np.arange(len(of)), of] = -np.inf
        k = min(near, n)
        close = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        links[of] = robust_prune(x, of, np.concatenate([close, rng.integers(0, n, (len(of), more))], axis=1), degree, alpha)
    # reverse edges; a node that gets too many is pruned again
    src, dst = np.repeat(np.arange(n), degree), links.ravel()
    real = dst >= 0
    both = np.unique(np.concatenate([src[real] * n + dst[real], dst[real].astype(np.int64) * n + src[real]]))
    out = np.split(both % n, np.searchsorted(both // n, np.arange(1, n)))
    for i, own in enumerate(out):
        if len(own) > 2 * degree:
            pruned = robust_prune(x, np.array([i]), own[None], 2 * degree, alpha)[0]
            out[i] = pruned[pruned >= 0]
    return connected(x, out)


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def connected(x: np.ndarray, out: list[np.ndarray]) -> list[np.ndarray]:
    """Edges from near reached nodes to those that the medoid doesn't reach."""
    n, reached = len(x), np.zeros(len(x), dtype=bool)
    todo = [medoid(x)]
    reached[todo] = True
    while True:
        while todo:
            found = np.unique(np.concatenate([out[i] for i in todo]))
            found = found[~reached[found]]
            reached[found] = True
            todo = found.tolist()
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return out
        there, one = np.flatnonzero(reached), lost[0]
        host = int(there[(x[there] @ x[one]).argmax()])
        out[host] = np.append(out[host], one)
        reached[one] = True
        todo = [int(one)]
    return out


def padded(out: list[np.ndarray]) -> np.ndarray:
    width = max((len(o) for o in out), default=0) or 1
    table = np.full((len(out), width), -1, dtype=np.int32)
    for i, o in enumerate(out):
        table[i, : len(o)] = o
    return table


def range_search(x: np.ndarray, table: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM, slack: float = SLACK) -> list[np.ndarray]:
    """For each query the nodes of similarity ``least`` or more that are found (verified by the caller).

    Greedy from the medoid until the beam's best nodes are all expanded; then
    everything within ``least - slack`` that was seen is expanded, as long as
    something new turns up there.
    """
    n, q = len(x), len(queries)
    seen = np.zeros((q, n), dtype=bool)
    spread = np.zeros((q, n), dtype=bool)  # expanded
    ranged = np.zeros((q, n), dtype=bool)
    sims = np.full((q, n), -2, dtype=np.float32)

    def look(r: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expands one node for each of the rows r; its neighbours, and their similarities where they are new (-4 elsewhere)."""
        spread[r, nodes] = True
        near = table[nodes]
        new = (near >= 0) & ~seen[r[:, None], near]
        at, place = np.nonzero(new)
        rr, node = r[at], near[at, place]
        s = np.einsum("nd,nd->n", x[node], queries[rr])
        seen[rr, node] = True
        sims[rr, node] = s
        ranged[rr, node] = s >= least - slack
        score = np.full(near.shape, -4, dtype=np.float32)
        score[at, place] = s
        return near, score

    start = medoid(x)
    seen[:, start] = True
    sims[:, start] = queries @ x[start]
    ranged[:, start] = sims[:, start] >= least - slack
    # the best nodes seen, their similarities, and these again where the node isn't expanded yet; empty places have -4
    active = np.arange(q)
    best, score = np.full((q, beam), start, dtype=np.int32), np.full((q, beam), -4, dtype=np.float32)
    score[:, 0] = sims[:, start]
    open_ = score.copy()
    while len(active):
        pick = open_.argmax(axis=1)
        rows = np.arange(len(active))
        going = open_[rows, pick] > -3
        if not going.all():
            active, pick, best, score, open_ = active[going], pick[going], best[going], score[going], open_[going]
            rows = np.arange(len(active))
            if not len(active):
                break
        open_[rows, pick] = -4
        # a node seen before is in the beam already, or was worse than all of it
        near, new = look(active, best[rows, pick])
        best, score, open_ = (np.concatenate([a, b], axis=1) for a, b in ((best, near), (score, new), (open_, new)))
        top = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
        best, score, open_ = (a[rows[:, None], top] for a in (best, score, open_))
    while True:
        r, node = np.nonzero(ranged & ~spread)
        if not len(r):
            break
        for a in range(0, len(r), 4096):  # bounds the vectors gathered at once
            look(r[a : a + 4096], node[a : a + 4096])
    return [np.flatnonzero(sims[k] >= least - 1e-4) for k in range(q)]


def shard_links(x: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, least: float, block: int = 128) -> list[np.ndarray]:
    """Each query's verified neighbours (double precision) in a shard of unit vectors.

    A sample of the queries is audited against all vectors of the shard; while
    its recall is too low the beam is doubled, and at last all are compared.
    """
    small, table = x.astype(np.float32), padded(graph)
    wide = queries.astype(np.float32)
    audit = np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int) if len(queries) else np.zeros(0, int)
    truth = [set(np.flatnonzero(x @ queries[i] >= least).tolist()) for i in audit]
    beam = BEAM
    while True:
        if beam > min(WIDEST, len(x) - 1):
            near = [np.flatnonzero(row >= least - 1e-4) for a in range(0, len(queries), block) for row in wide[a : a + block] @ small.T]
            return [g[x[g] @ v >= least] for g, v in zip(near, queries, strict=True)]
        got = [g for a in range(0, len(audit), block) for g in range_search(small, table, wide[audit[a : a + block]], least, beam)]
        hits = sum(len(t & set(g.tolist())) for t, g in zip(truth, got, strict=True))
        if hits >= LEAST_RECALL * sum(map(len, truth)):
            break
        beam *= 2
    out = []
    for a in range(0, len(queries), block):
        for k, g in enumerate(range_search(small, table, wide[a : a + block], least, beam)):
            out.append(g[x[g] @ queries[a + k] >= least])
    return out


def _unit(vectors) -> np.ndarray:
    """Unit vectors in double precision; scaled by their largest component first, so that no square under- or overflows."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    x = np.ldexp(x, -exponent)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_parts(x: np.ndarray, count: int, shard: int, half: float, link: float) -> tuple[np.ndarray, np.ndarray | None]:
    """Centres of a cluster's parts from a sample of its ``count`` vectors, and the centre of a ball of ``shard`` members or more, if there seems to be one.

    One centre only, where the sample outside the ball would go to over ``MOST_PARTS`` parts each.
    """
    k = max(1, min(FAN, -(-count // shard), len(x) // 8))
    centres, ball = kmeans(x, k), None
    inside = x @ centres.T >= half
    near = inside[:, inside.sum(axis=0).argmax()]
    for _ in range(2):
        if near.any():
            ball = x[near].mean(axis=0)
            ball /= np.linalg.norm(ball)
            near = x @ ball >= half
    ball = ball if ball is not None and near.mean() * count >= shard else None
    rest = x if ball is None else x[~near]
    if len(rest) and len(parts_of(rest, np.ones(len(rest), dtype=bool), centres, link)[0]) > MOST_PARTS * len(rest):
        centres = rest.mean(axis=0, keepdims=True)
    return centres, ball


def parts_of(x: np.ndarray, home: np.ndarray, centres: np.ndarray, link: float, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, part, is nearest) for every part where a unit vector may meet one that it links with, within the angle ``link``.

    Vectors nearest to different centres lie on either side of the plane halfway
    between these, so if they link the nearer of the two is within half the
    angle of it, and it goes to the other's part. No linked vector is further
    than the whole angle beyond any plane that bounds its partner's part. Guests
    (not ``home``), whom nobody follows, go by the second rule alone.
    """
    gap = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    apart = gap > 1e-9
    whole, half = (np.sin(min(np.pi / 2, a)) + 1e-9 for a in (link, link / 2))
    rows, parts, first = [], [], []
    for a in range(0, len(x), block):
        near = x[a : a + block] @ centres.T
        own = near.argmax(axis=1)
        # how far beyond the plane between two centres the vector is, seen from the first
        beyond = (near[:, None, :] - near[:, :, None]) / np.where(apart, gap, np.inf)
        to_own = beyond[np.arange(len(own)), :, own]
        ok = (beyond.max(axis=2) <= whole) & ((to_own <= half) | ~home[a : a + block, None])
        ok[np.arange(len(own)), own] = True
        r, p = np.nonzero(ok)
        rows.append(r + a)
        parts.append(p)
        first.append(p == own[r])
    none = np.zeros(0, dtype=int)
    return np.concatenate([none, *rows]), np.concatenate([none, *parts]), np.concatenate([none.astype(bool), *first])


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, shard: int = SHARD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` of every vector.

    Vectors link if their labels (and lengths) are equal and their cosine is
    ``least`` or more. Equal vectors are one class, compared once; ``n_links``
    counts their rows.

    Classes of a label are clustered, level by level, with centres that tasks
    fit on about ``fit_rows`` members of a cluster; each class belongs to its
    home, the nearest cluster at every level, and as a guest to all clusters
    that may be home to a class that it links with and that doesn't come to it
    (``parts_of``), so that no pair is lost between clusters. A cluster whose
    parts would save too few comparisons, or copy its vectors too often, stays whole. On every cluster's shard
    a graph is built; the adjacency lists of a class from its shards are
    united; and every class searches its home's shard in the united graph.
    Links are verified in double precision, and each shard audits its recall. A ball's members, all within
    half the angle of its centre, link with each other; the vectors of its
    cluster that may link with some of them, by their angle to the centre, are
    compared with all of them, in blocks. A shard that can't be split is cut by
    hash, and its cuts all meet each other.

    Null ids, null labels, and vectors that are null, empty, zero or hold null
    or non-finite components link with nothing: n_links 0, their own component,
    kept (with a null id: component null, not kept). Repeated rows give a row
    each and link with each other. An empty table gives no rows; other columns
    aren't read.
    """
    kind = rows.schema[vector_col].dataType.elementType
    vec = F.col(vector_col) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.transform(F.col(vector_col), lambda v: v.cast("double"))
    vector = "array<float>" if isinstance(kind, T.FloatType) else "array<double>"
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    finite = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    valid = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda v: v != 0), F.lit(False))
    # two hashes of 64 bits tell vectors apart; a class is numbered once its row is written
    base = base.withColumn("h1", F.when(valid, F.xxhash64("label", "vec"))).withColumn("h2", F.when(valid, F.xxhash64(F.lit(1), "label", "vec")))
    classes = base.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = cut_lineage(classes.select(F.monotonically_increasing_id().alias("class"), "h1", "h2", "least_id", "n", "vec", F.concat_ws("/", F.size("vec").cast("string"), "label").alias("node")))
    # half the angle of the least cosine, one and a half of it, and slack against rounding
    half, far = ((1 + least) / 2) ** 0.5 + 1e-9, np.cos(min(np.pi, 1.5 * np.arccos(least))) - 1e-9

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        centres, ball = fit_parts(_unit(pdf["vec"]), int(pdf["size"].iloc[0]), shard, half, link)
        return pd.DataFrame({"node": [pdf["node"].iloc[0]], "centres": [centres.ravel().tolist()], "ball": [None if ball is None else ball.tolist()], "k": [len(centres)]})

    def assign(part: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        columns = ["class", "n", "vec", "node", "parent", "home", "kind"]
        if not len(part) or not len(fitted):
            return pd.DataFrame(columns=columns)
        node, x, home = part["node"].iloc[0], _unit(part["vec"]), part["home"].to_numpy()
        centres, ball = np.asarray(fitted["centres"].iloc[0]).reshape(-1, x.shape[1]), fitted["ball"].iloc[0]
        inside, close = np.zeros(len(x), dtype=bool), np.zeros(0, dtype=int)
        if ball is not None:
            to_ball = x @ np.asarray(ball)
            inside = home & (to_ball >= half)
            close = np.flatnonzero(~inside & (to_ball >= far))
        core, rest = np.flatnonzero(inside), np.flatnonzero(~inside)
        row, to, nearest = parts_of(x[rest], home[rest], centres, link)
        row = rest[row]
        at = np.concatenate([core, close, row])
        names = [f"*{node}"] * (len(core) + len(close)) + [f"{node}/{k}" for k in to.tolist()]
        homes = np.concatenate([np.ones(len(core), dtype=bool), np.zeros(len(close), dtype=bool), home[row] & nearest])
        kinds = np.repeat([0, 1, 2], [len(core), len(close), len(row)])
        return pd.DataFrame({"class": part["class"].to_numpy()[at], "n": part["n"].to_numpy()[at], "vec": part["vec"].to_numpy()[at], "node": names, "parent": node, "home": homes, "kind": kinds})[columns]

    link = float(np.arccos(least))
    hosts, every = F.sum(F.col("home").cast("long")), F.count(F.lit(1))
    members, balls = classes.select("class", "n", "vec", "node", F.lit(True).alias("home")), None
    for level in range(LEVELS):
        # "!" marks clusters that no split helps
        sizes = cut_lineage(members.where(~F.col("node").endswith("!")).groupBy("node").agg(hosts.alias("size"), every.alias("all")).where(F.col("size") > 2 * shard))
        if sizes.isEmpty():
            break
        large = members.join(sizes, "node")
        at = F.shiftrightunsigned(F.xxhash64("class", F.lit(level)), 11).cast("double") / float(1 << 53)
        parts = large.where(F.col("home") & (at < F.lit(float(fit_rows)) / F.col("size"))).groupBy("node").applyInPandas(fit, "node string, centres array<double>, ball array<double>, k int")
        parts = parts.where("k > 1 or ball is not null")
        salts = F.ceil(F.col("all") / ASSIGN_ROWS).cast("int")
        parts = cut_lineage(parts.join(sizes, "node").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("node", "salt", "centres", "ball"))
        # rows of clusters that stay whole aren't moved
        large = large.join(F.broadcast(parts.where("salt = 0").select("node")), "node", "left_semi")
        dealt = large.withColumn("salt", F.pmod(F.xxhash64("class"), salts).cast("int")).select("class", "n", "vec", "node", "home", "salt")
        moved = dealt.groupBy("node", "salt").cogroup(parts.groupBy("node", "salt")).applyInPandas(assign, f"class long, n long, vec {vector}, node string, parent string, home boolean, kind int")
        moved = cut_lineage(moved)
        after = moved.where("kind = 2").groupBy("parent", "node").agg((hosts * every).alias("work")).groupBy("parent").agg(F.sum("work").alias("work"))
        plan = sizes.join(parts.where("salt = 0").select("node", F.col("node").alias("split")), "node", "left").join(after.withColumnRenamed("parent", "node"), "node", "left")
        # a cluster whose sample was empty, or whose parts would save too little, stays as it is
        splits = F.col("split").isNotNull() & (F.coalesce("work", F.lit(0)) < LEAST_GAIN * F.col("size") * F.col("all"))
        plan = cut_lineage(plan.select("node", splits.alias("splits")))
        moved = moved.join(plan.where("splits").select(F.col("node").alias("parent")), "parent", "left_semi")
        stay = members.join(plan, "node", "left").where(~F.coalesce("splits", F.lit(False)))
        stay = stay.select("class", "n", "vec", F.when(F.col("splits").isNotNull(), F.concat("node", F.lit("!"))).otherwise(F.col("node")).alias("node"), "home")
        members = cut_lineage(stay.union(moved.where("kind = 2").select("class", "n", "vec", "node", "home")))
        found = cut_lineage(moved.where("kind < 2").select("class", "n", "vec", "node", "home", "kind"))
        balls = found if balls is None else balls.union(found)
    seats = members.select("class", "node", "home")
    seats = (seats if balls is None else seats.union(balls.select("class", "node", "home"))).groupBy("class")
    seats = cut_lineage(seats.agg(F.concat(F.array(F.max(F.when(F.col("home"), F.col("node")))), F.collect_list(F.when(~F.col("home"), F.col("node")))).alias("clusters")))
    cuts = members.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / (CUT * shard)).cast("int").alias("cuts"))
    members = cut_lineage(members.drop("home").join(cut_lineage(cuts), "node").withColumn("cut", F.pmod("class", F.col("cuts")).cast("int")).join(seats, "class"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class", kind="stable")
        ids = pdf["class"].to_numpy()
        graph = build_graph(_unit(pdf["vec"]).astype(np.float32)) if len(ids) > 1 else [np.zeros(0, dtype=int)]
        return pd.DataFrame({"class": ids, "near": [ids[g] for g in graph]})

    lists = members.groupBy("node", "cut").applyInPandas(build, "class long, near array<long>")
    united = lists.groupBy("class").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    graph = members.join(united, "class")
    # a cut's graph meets the queries of each cut of its cluster; its own are among its rows
    ask = graph.withColumn("asks", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumn("guest", F.lit(False))
    guests = members.where((F.col("cuts") > 1) & (F.col("clusters")[0] == F.col("node"))).withColumn("near", F.lit(None).cast("array<long>"))
    guests = guests.withColumn("asks", F.col("cut")).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).where("cut <> asks").withColumn("guest", F.lit(True))
    tasks = ask.unionByName(guests)

    def rows_of(links: dict[int, int], tree: list[tuple[int, int]]) -> pd.DataFrame:
        """What a task found: links by class (b is null), and as many pairs as connect them."""
        b = [None] * len(links) + [t[1] for t in tree]
        return pd.DataFrame({"a": [*links, *(t[0] for t in tree)], "b": pd.array(b, dtype="Int64"), "links": [*links.values(), *[0] * len(tree)]})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        here = pdf[~pdf["guest"]].sort_values("class", kind="stable")
        ids, x, node = here["class"].to_numpy(), _unit(here["vec"]), pdf["node"].iloc[0]
        weight, seats = here["n"].to_numpy(), here["clusters"].tolist()
        home = np.array([s[0] for s in seats], dtype=object)
        own_cut = bool((here["cut"] == here["asks"]).iloc[0])
        asking = here[home == node] if own_cut else pdf[pdf["guest"]]
        if not len(asking):
            return rows_of({}, [])
        near = []
        for own in here["near"]:
            at = np.searchsorted(ids, own)
            at[at == len(ids)] = 0
            near.append(at[ids[at] == own])
        graph_ = connected(x.astype(np.float32), near) if len(ids) > 1 else near
        found = shard_links(x, graph_, _unit(asking["vec"]), least)
        links, tree, groups = {}, [], Groups(len(ids) + len(asking))
        own_at = np.searchsorted(ids, asking["class"].to_numpy())
        for k, (q, n, seat, got) in enumerate(zip(asking["class"].tolist(), asking["n"].tolist(), asking["clusters"].tolist(), found, strict=True)):
            # the members of a ball that q is compared with anyway are left to the ball
            got = got[(ids[got] != q) & np.array([not (home[j][0] == "*" and home[j] in seat) for j in got.tolist()], dtype=bool)]
            links[q] = links.get(q, 0) + int(weight[got].sum())
            inside = own_cut and ids[own_at[k]] == q
            tree += [(q, int(ids[j])) for j in groups.join(int(own_at[k]) if inside else len(ids) + k, got).tolist()] if len(got) else []
            for j in got[home[got] != node].tolist():
                if home[j] not in seat:  # that one's own search doesn't meet q
                    links[int(ids[j])] = links.get(int(ids[j]), 0) + n
        return rows_of(links, tree)

    found = tasks.groupBy("node", "cut", "asks").applyInPandas(search, "a long, b long, links long")
    if balls is not None:
        found = found.union(_ball_links(cut_lineage(balls.join(seats, "class")), least, 4 * shard, rows_of))
    found = cut_lineage(found)
    linked = components(found.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    counts = found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    grouped = classes.select("class", "h1", "h2", "least_id", "n").join(linked.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least_ids = cut_lineage(grouped.groupBy("component").agg(F.min("least_id").alias("group_least")))
    named = grouped.join(least_ids, "component").join(counts, "class", "left").select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("group_least"))
    out = base.select("id", "h1", "h2").join(cut_lineage(named), ["h1", "h2"], "left")
    component = F.coalesce("group_least", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _ball_links(balls: DataFrame, least: float, block: int, rows_of) -> DataFrame:
    """Links of balls' members (``kind`` 0) with each other, all of them, and with the vectors near the ball (1), compared in blocks of ``block`` by ``block``."""
    core, near = balls.where("kind = 0"), balls.where("kind = 1")
    sums = cut_lineage(core.groupBy("node").agg(F.sum("n").alias("weight"), F.min("class").alias("pivot"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cuts")))
    beside = cut_lineage(near.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("others")))
    inner = core.join(sums, "node").select(F.col("class").alias("a"), F.col("pivot").alias("b"), (F.col("weight") - F.col("n")).alias("links"))
    inner = inner.select("a", F.lit(None).cast("long").alias("b"), "links").union(inner.where("a <> b").select("a", "b", F.lit(0).cast("long")))
    both = sums.select("node", "cuts").join(beside, "node")
    pieces = core.join(both, "node").withColumn("cut", F.pmod("class", F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    guests = near.join(both, "node").withColumn("other", F.pmod("class", F.col("others")).cast("int")).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        own, asking, node = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1], pdf["node"].iloc[0]
        if not len(own) or not len(asking):
            return rows_of({}, [])
        x, ids, weight, seats = _unit(own["vec"]), own["class"].to_numpy(), own["n"].to_numpy(), own["clusters"].tolist()
        links, tree, groups = {}, [], Groups(len(ids) + len(asking))
        for k, (q, n, seat, v) in enumerate(zip(asking["class"].tolist(), asking["n"].tolist(), asking["clusters"].tolist(), _unit(asking["vec"]), strict=True)):
            got = np.flatnonzero(x @ v >= least)
            if seat[0][0] == "*" and seat[0] < node:  # q's own ball compares these with it
                got = got[[seat[0] not in seats[j] for j in got.tolist()]] if len(got) else got
            if len(got):
                links[q] = links.get(q, 0) + int(weight[got].sum())
                for j in got.tolist():
                    links[int(ids[j])] = links.get(int(ids[j]), 0) + n
                tree += [(q, int(ids[j])) for j in groups.join(len(ids) + k, got).tolist()]
        return rows_of(links, tree)

    columns = ["node", "cut", "other", "kind", "class", "n", "vec", "clusters"]
    met = pieces.select(*columns).union(guests.select(*columns)).groupBy("node", "cut", "other").applyInPandas(cross, "a long, b long, links long")
    return inner.union(met)

"""Near-duplicate embeddings by a robust-pruned flat graph.

1. Equal vectors are one class, so groups of copies cost one node.
2. Spherical k-means centroids, fitted on a bounded sample, cut space into
   clusters; each class goes to the nearest ones (overlapping shards). A shard
   over ``CAP`` classes is dealt over blocks, with a task for each two blocks,
   so that a hot cluster is never in one task.
3. Each task builds a graph of its classes: candidates are pruned robustly (a
   neighbour that is closer, by ``ALPHA``, to one already kept than to the
   node goes), and lists of all tasks are united per node.
4. Each task searches its part of the united graph for all its classes: greedy
   from the medoid, then outwards over everything within the range. A class
   whose candidates all lie within the range may have more neighbours than
   that, which no edge leads to: it is compared with all classes of its task
   instead. What is found is verified by cosine in double precision.

5. Recall is audited: links of a hashed sample of classes are counted exactly
   against all classes. Under ``RECALL`` the search is made again with every
   class compared with its whole task and dealt to four times the shards, up to
   all that its range may touch, where nothing is missed.

Tasks return link counts and one edge per class, never pairs: a pair in
several tasks counts in the one of its least common shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, table
from .graph import components

#: Classes in a block; the sample and the number of centroids that are held on the driver and broadcast at most.
CAP, SAMPLE, MOST_CENTROIDS = 1500, 20_000, 1024
#: Shards a class goes to at most; kept neighbours, candidates, slack of pruning.
OVERLAP, DEGREE, CANDIDATES, ALPHA = 4, 24, 64, 1.2
#: Beam of the greedy search; how far under the threshold the range search still expands.
BEAM, SLACK = 16, 0.03
#: Classes audited, at most, of all and again of those with links (what is broadcast); the least recall that is accepted.
AUDIT, RECALL = 200, 0.9


def centroids(x: np.ndarray, k: int, steps: int = 8, seed: int = 0) -> np.ndarray:
    """k unit centroids of unit rows by spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-30)[:, None], c)
    return c


def robust_prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of every row of unit ``x``, -1 where there are fewer than ``degree``, and the cosine of the last candidate, -9 where all rows are candidates."""
    n = len(x)
    m = min(candidates, n - 1)
    out, last = np.full((n, degree), -1, np.int64), np.full(n, -9.0)
    if m <= 0:
        return out, last
    for at in range(0, n, 256):
        rows = np.arange(at, min(n, at + 256))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -9
        near = np.argpartition(-sims, m - 1, axis=1)[:, :m] if m < n else np.argsort(-sims, axis=1)[:, :m]
        order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        if m < n - 1:
            last[rows] = sims[np.arange(len(rows)), near[:, -1]]
        own = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, near, 1)))
        v = x[near]
        between = np.sqrt(np.maximum(0, 2 - 2 * (v @ v.transpose(0, 2, 1))))
        alive = np.ones(near.shape, bool)
        i = np.arange(len(rows))
        for d in range(min(degree, m)):
            first = np.argmax(alive, axis=1)
            some = alive[i, first]
            out[rows[some], d] = near[i, first][some]
            alive &= alpha * between[i, first] > own
            alive[i, first] = False
            if not alive.any():
                break
    return out, last


def compared(x: np.ndarray, queries: np.ndarray, least: float) -> np.ndarray:
    """All pairs of a row of ``queries`` and any row of unit ``x`` at cosine ``least`` or more, in the form of ``range_search``."""
    n, found = len(x), [np.zeros(0, np.int64)]
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        rows, cols = np.nonzero(x[q] @ x.T >= least - 1e-9)  # the caller verifies
        a, b = np.minimum(q[rows], cols), np.maximum(q[rows], cols)
        found.append(np.unique((a * n + b)[a < b]))
    return np.unique(np.concatenate(found))


def range_search(x: np.ndarray, adjacency: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM, slack: float = SLACK) -> np.ndarray:
    """Pairs (i < j) of rows of unit ``x`` at cosine ``least`` or more, as i * n + j, found from ``queries``.

    Greedy search from the medoid with a beam, then outwards from the beam and
    the query's own node to all neighbours of nodes within the range.
    """
    n, width = len(x), adjacency.shape[1]
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    found = []
    for at in range(0, len(queries), 128):
        q = queries[at : at + 128]
        i = np.arange(len(q))
        seen = np.zeros((len(q), n), bool)
        seen[:, medoid] = True
        ids, sims = np.full((len(q), beam), -1), np.full((len(q), beam), -9.0)
        done = np.ones((len(q), beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = medoid, x[q] @ x[medoid], False
        for _ in range(64):
            ready = np.where(done, -9.0, sims)
            best = np.argmax(ready, axis=1)
            live = ready[i, best] > -9
            if not live.any():
                break
            done[i, best] = True
            near = np.where(live[:, None], adjacency[np.where(live, ids[i, best], 0)], -1)
            near = np.where((near >= 0) & ~seen[i[:, None], near], near, -1)
            rows, cols = np.nonzero(near >= 0)
            seen[rows, near[rows, cols]] = True
            s = np.full(near.shape, -9.0)
            s[rows, cols] = np.einsum("ij,ij->i", x[q[rows]], x[near[rows, cols]])
            ids, sims, done = np.hstack([ids, near]), np.hstack([sims, s]), np.hstack([done, np.zeros(near.shape, bool)])
            top = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, done = (np.take_along_axis(y, top, 1) for y in (ids, sims, done))
        # outwards
        seen[:] = False
        seen[i, q] = True
        rows, cols = np.nonzero(sims >= least - slack)
        nodes = ids[rows, cols]
        fresh = ~seen[rows, nodes]
        rows, nodes = rows[fresh], nodes[fresh]
        seen[rows, nodes] = True
        hits = [(rows, nodes)]
        rows, nodes = np.concatenate([i, rows]), np.concatenate([q, nodes])
        while len(rows):
            near = adjacency[nodes].ravel()
            rows = np.repeat(rows, width)
            ok = near >= 0
            rows, near = rows[ok], near[ok]
            fresh = ~seen[rows, near]
            key = np.unique(rows[fresh] * n + near[fresh])
            rows, near = key // n, key % n
            seen[rows, near] = True
            s = np.einsum("ij,ij->i", x[q[rows]], x[near])
            keep = s >= least - slack
            rows, nodes = rows[keep], near[keep]
            hits.append((rows, nodes))
        rows, nodes = np.concatenate([r for r, _ in hits]), np.concatenate([c for _, c in hits])
        a, b = np.minimum(q[rows], nodes), np.maximum(q[rows], nodes)
        found.append(np.unique(a * n + b))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _stack(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column])


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, least: float = 0.95, cap: int = CAP, sample: int = SAMPLE, overlap: int = OVERLAP, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding", audit: int = AUDIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of every row of ``vectors``.

    ``n_links`` counts other rows at cosine ``least`` or more that the search
    found, ``component_id`` is the smallest vec_id reachable over links, and
    ``kept`` says whether that is the row's own. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing; so do ones
    of different lengths. Rows of one vec_id are rows of their own and linked
    through their name. An empty table gives no rows. ``recall`` is the same in
    every row: the audited share of links between different vectors that the
    search found, 1 where the sample has none, null where ``audit`` is 0.
    """
    v = pick(vectors, vec_id=id_col, e=vector_col)
    fine = F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0), F.lit(False))
    v = v.withColumn("key", F.when(F.col("vec_id").isNotNull() & fine, F.sha2(F.to_json(F.struct("e")), 256)))
    good = v.where("key IS NOT NULL")
    classes = table(good.groupBy("key").agg(F.min(F.struct("vec_id", "e")).alias("f"), F.count("*").alias("m")).select("key", F.col("f.vec_id").alias("id"), F.col("f.e").alias("e"), "m").withColumn("dim", F.size("e")).withColumn("c", F.xxhash64("key")))
    whole, reach = False, overlap
    while True:
        counted, star, shards = _search(classes, least, cap, sample, reach, seed, whole)
        recall = audited(classes, counted, least, audit, seed) if audit else None
        if recall is None or recall >= RECALL or (whole and reach >= shards):
            break
        whole, reach = True, 4 * reach
    of_class = classes.select("key", "c", "id", "m").join(counted, "c", "left").select("key", F.col("id").alias("cid"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"))
    member = v.join(of_class, "key", "left")
    own = member.where("cid <> vec_id").select(F.col("vec_id").alias("a"), F.col("cid").alias("b")).distinct()
    roots = components(star.unionByName(own))
    named = member.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links")).join(roots, F.col("vec_id") == F.col("node"), "left")
    named = named.withColumn("component_id", F.coalesce("root", "vec_id"))
    return named.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("recall"))


def audited(classes: DataFrame, counted: DataFrame, least: float, queries: int, seed: int) -> float:
    """Share of the links of sampled classes that ``counted`` has: each is compared with all of ``classes``, without a shuffle of vectors."""
    order = F.xxhash64("c", F.lit(seed + 1)), F.col("c")
    names = classes.orderBy(*order).limit(queries).select("c").unionByName(counted.where("links > 0").orderBy(*order).limit(queries).select("c")).distinct()
    asked = classes.join(F.broadcast(names), "c").join(counted, "c", "left").select("c", "dim", "e", F.coalesce("links", F.lit(0)).alias("links")).toPandas()  # 2 * queries rows at most
    held = {int(dim): (g["c"].to_numpy(), _unit(_stack(g["e"]))) for dim, g in asked.groupby("dim")}
    shared = classes.sparkSession.sparkContext.broadcast(held)

    def exact(frames):
        for f in frames:
            for dim, g in f.groupby("dim"):
                if int(dim) in shared.value:
                    c, q = shared.value[int(dim)]
                    hit = (_unit(_stack(g["e"])) @ q.T >= least) & (g["c"].to_numpy()[:, None] != c[None, :])
                    yield pd.DataFrame({"c": c, "n": g["m"].to_numpy() @ hit})

    full = classes.select("c", "m", "dim", "e").mapInPandas(exact, "c bigint, n bigint").agg(F.sum("n").alias("n")).first()["n"] or 0
    return min(1.0, float(asked["links"].sum()) / full) if full else 1.0


def _search(classes: DataFrame, least: float, cap: int, sample: int, overlap: int, seed: int, whole: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """(c, links), edges (a, b) between classes, and the most centroids of a length; c is a 64-bit name of a class.

    With ``whole`` every class is compared with all of its task.
    """
    spark = classes.sparkSession
    dims = [r["dim"] for r in classes.groupBy("dim").agg(F.count("*").alias("c")).orderBy(F.desc("c")).limit(64).collect()]
    n = classes.count()
    k = int(min(MOST_CENTROIDS, max(1, n // max(1, cap // 2))))
    held = {}
    for dim in dims:  # lengths beyond the 64 commonest share one shard per length, dealt over blocks like any other
        rows = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("c", F.lit(seed)), "c").limit(sample // len(dims)).select("e").toPandas()
        held[dim] = centroids(_unit(_stack(rows["e"])), k, seed=seed)
    shared = spark.sparkContext.broadcast(held)
    reach = (2 - 2 * least) ** 0.5

    def assign(frames):
        for f in frames:
            out = []
            for dim, e in zip(f["dim"], f["e"], strict=True):
                c = shared.value.get(dim)
                if c is None:
                    out.append([0])
                    continue
                s = c @ _unit(np.asarray(e, np.float64)[None, :])[0]
                near = np.argsort(-s, kind="stable")[:overlap]
                # a neighbour within the range can only be at home where this holds
                ok = s[near[0]] - s[near] <= reach * np.linalg.norm(c[near[0]] - c[near], axis=1) + 1e-9
                out.append([int(i) for i in near[ok]])
            yield pd.DataFrame({"c": f["c"], "id": f["id"], "m": f["m"], "dim": f["dim"], "e": f["e"], "shards": out})

    vector = classes.schema["e"].dataType.simpleString()
    dealt = table(classes.select("c", "id", "m", "dim", "e").mapInPandas(assign, f"c bigint, id bigint, m bigint, dim int, e {vector}, shards array<int>"))
    placed = dealt.withColumn("shard", F.explode("shards"))
    sizes = placed.groupBy("dim", "shard").agg(F.count("*").alias("c")).select(F.col("dim").alias("d2"), F.col("shard").alias("s2"), F.ceil(F.col("c") / cap).cast("int").alias("g"))
    placed = placed.join(sizes, (F.col("dim") == F.col("d2")) & (F.col("shard") == F.col("s2")))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("c"), F.col("g")).cast("int"))
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    tasks = tasks.withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other")).select("dim", "shard", "b1", "b2", "c", "id", "m", "e", "shards", "block")

    def build(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("c", kind="stable")
        names, (near, last) = f["c"].to_numpy(), robust_prune(_unit(_stack(f["e"])))
        return pd.DataFrame({"c": names, "near": [names[r[r >= 0]] for r in near], "dense": last >= least - SLACK})

    by = ("dim", "shard", "b1", "b2")
    lists = tasks.select(*by, "c", "e").groupBy(*by).applyInPandas(build, "c bigint, near array<bigint>, dense boolean")
    united = table(lists.groupBy("c").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("dense").alias("dense")))  # a list for each task of a node

    def search(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("c", kind="stable")
        shard, b1, b2 = int(f["shard"].iloc[0]), int(f["b1"].iloc[0]), int(f["b2"].iloc[0])
        names, ids, m, block = f["c"].to_numpy(), f["id"].to_numpy(), f["m"].to_numpy(), f["block"].to_numpy()
        raw = _stack(f["e"])
        x, n = _unit(raw), len(f)
        at = {c: i for i, c in enumerate(names.tolist())}
        pairs = [(i, at[o]) for i, near in enumerate(f["near"]) if near is not None for o in near.tolist() if o in at]
        both = np.unique(np.array([p for a, b in pairs for p in ((a, b), (b, a))], np.int64).reshape(-1, 2), axis=0)
        width = np.bincount(both[:, 0], minlength=n)
        adjacency = np.full((n, max(1, width.max(initial=0))), -1, np.int64)
        adjacency[both[:, 0], np.arange(len(both)) - np.repeat(np.cumsum(width) - width, width)] = both[:, 1]
        dense = f["dense"].to_numpy(bool) | whole
        key = np.union1d(range_search(x, adjacency, np.nonzero(~dense)[0], least), compared(x, np.nonzero(dense)[0], least))
        i, j = key // n, key % n
        if b1 != b2:
            i, j = i[block[i] != block[j]], j[block[i] != block[j]]
        cos = np.concatenate([np.einsum("ij,ij->i", x[i[s : s + 50_000]], x[j[s : s + 50_000]]) for s in range(0, len(i), 50_000)] or [np.zeros(0)])
        i, j = i[cos >= least], j[cos >= least]
        wide = max(map(len, f["shards"]))
        homes = np.array([[*s, *[-1] * (wide - len(s))] for s in f["shards"]])
        first = np.ones(len(i), bool)
        for a in range(wide):
            for b in range(wide):
                first &= ~((homes[i, a] == homes[j, b]) & (homes[i, a] >= 0) & (homes[i, a] < shard))
        i, j = i[first], j[first]
        links = np.bincount(i, m[j], n) + np.bincount(j, m[i], n)
        root = np.arange(n)
        while True:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = np.nonzero(links > 0)[0]
        return pd.DataFrame({"c": names[some], "links": links[some].astype(np.int64), "a": ids[some], "b": ids[root[some]]})

    found = table(tasks.join(united, "c", "left").groupBy(*by).applyInPandas(search, "c bigint, links bigint, a bigint, b bigint"))
    return found.groupBy("c").agg(F.sum("links").alias("links")), found.where("a <> b").select("a", "b").distinct(), k

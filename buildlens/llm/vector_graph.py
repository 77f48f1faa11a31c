"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

1. Equal vectors form one class with a multiplicity, so any number of copies costs one row.
2. Cells. The classes of one label and dimension are dealt to the cells of sampled pivots, and
   cells above ``SHARD`` again, until they are small: a tree of Voronoi cells without a bound
   on their number. A class has one home, the cell of its nearest pivots, and lies besides in
   those cells whose pivot is nearly as near.
3. Graph. Each cell is built into a flat graph: classes are added in random order, a greedy
   search from the medoids on the graph so far gives the candidates, and robust pruning keeps
   an edge only where no kept neighbour lies much nearer to its end.
4. Union. The lists that a class has in several cells are joined: the part of a list that lies
   near enough to hold a common link, and leads out of a cell, is added to that cell with the
   vectors at its ends.
5. Search. Every class is searched once, in its home: greedily from the medoids, then, once
   within range, by expanding every vector in range. All links are verified by cosine in
   double precision; a link holds wherever it is found and counts once.

A cell above ``SHARD`` that has a single pivot is one dense spot. Vectors within half the link
angle of its centre are linked with each other for certain (the angle is a metric), which is
counted without a look at pairs; the others of that cell are compared with it in blocks.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.llm.components import connected_components
from buildlens.llm.shared import written

THRESHOLD = 0.93
#: Classes of a cell that is not split further, and of the buckets that are dealt at a time.
SHARD, BUCKET = 1500, 5000
#: Pivots that a cell is split by, at most, and sampled classes for each of them.
PIVOTS, SAMPLED = 64, 4
#: Cells that a class may lie in at each split, and the loss of cosine up to which it does.
OVERLAP, MARGIN = 2, 0.05
#: Edges kept by pruning and at most held, candidates that pruning looks at, and its slack.
DEGREE, WIDTH, POOL, ALPHA = 14, 28, 40, 1.2
#: Width of the beam, vectors a step expands, starts of a search, classes for each medoid.
BEAM, STEP, STARTS, PER_MEDOID = 16, 2, 3, 100
#: Vectors added or searched at a time.
BATCH = 256
HALF = float(np.cos(np.arccos(THRESHOLD) / 2) + 1e-9)
#: Ends of a list further from its class than twice the link angle cannot share a link with it.
NEAR = float(np.cos(2 * np.arccos(THRESHOLD)) - 1e-6)


def usable(v: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x.cast("double") != 0), F.lit(False))


def unit(rows) -> np.ndarray:
    """Rows as unit vectors in double precision, whatever their scale."""
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# ------------------------------------------------------------------- one graph


def pruned(x: np.ndarray, own: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Robust pruning: for each of ``own`` the kept ones of its candidates (padded with -1)."""
    cand = np.where(cand == own[:, None], -1, cand)
    order = np.sort(cand, axis=1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
    sim = np.einsum("bd,bpd->bp", x[own], x[order])
    sim[order < 0] = -3
    top = np.argsort(-sim, axis=1, kind="stable")[:, :POOL]
    cand, sim = np.take_along_axis(order, top, 1), np.take_along_axis(sim, top, 1)
    v = x[cand]
    between = v @ v.transpose(0, 2, 1)
    alive = cand >= 0
    out = np.full((len(own), DEGREE), -1, np.int64)
    rows = np.arange(len(own))
    for k in range(DEGREE):
        at = alive.argmax(1)
        some = alive[rows, at]
        if not some.any():
            break
        out[some, k] = cand[rows, at][some]
        alive &= ALPHA * (1 - between[rows, at]) > 1 - sim
        alive[rows, at] = False
    return out


def walk(x: np.ndarray, lists: np.ndarray, starts: np.ndarray, queries: np.ndarray, hits_above: float | None = None):
    """Greedy beam search of the vectors ``queries`` (rows of x) over ``lists`` from the best of
    ``starts``: (beam of ids, seen, hits), hits being (query row, vector) at or above a cosine."""
    q = x[queries]
    b, n = len(q), len(x)
    rows = np.arange(b)
    first = q @ x[starts].T
    k = min(STARTS, len(starts))
    near = np.argpartition(-first, k - 1, axis=1)[:, :k]
    beam = np.full((b, BEAM), -1, np.int64)
    score = np.full((b, BEAM), -np.inf, np.float32)
    beam[:, :k], score[:, :k] = starts[near], np.take_along_axis(first, near, 1)
    fresh = beam >= 0
    seen = np.zeros((b, n), bool)
    seen[rows[:, None], beam[:, :k]] = True
    hits = []
    if hits_above is not None:
        r, c = np.nonzero(score >= hits_above)
        hits.append((r, beam[r, c]))
    live = rows
    while len(live):
        open_score = np.where(fresh[live], score[live], -np.inf)
        top = np.argpartition(-open_score, STEP - 1, axis=1)[:, :STEP]
        ok = np.take_along_axis(open_score, top, 1) > -np.inf
        live, top, ok = live[ok.any(1)], top[ok.any(1)], ok[ok.any(1)]
        if not len(live):
            break
        fresh[live[:, None], top] = False
        step = np.where(ok[:, :, None], lists[beam[live[:, None], top]], -1).reshape(len(live), -1)
        r, c = np.nonzero(step >= 0)
        code = np.unique(live[r] * n + step[r, c])
        rr, vv = code // n, code % n
        new = ~seen[rr, vv]
        rr, vv = rr[new], vv[new]
        if not len(rr):
            continue
        seen[rr, vv] = True
        s = np.einsum("ij,ij->i", q[rr], x[vv])
        if hits_above is not None:
            hits.append((rr[s >= hits_above], vv[s >= hits_above]))
        count = np.bincount(rr, minlength=b)
        got = np.flatnonzero(count)
        wide = int(count.max())
        place = np.arange(len(rr)) - np.repeat(np.cumsum(count) - count, count)
        more = np.full((b, wide), -np.inf, np.float32)
        ids = np.full((b, wide), -1, np.int64)
        more[rr, place], ids[rr, place] = s, vv
        all_s, all_i = np.hstack([score[got], more[got]]), np.hstack([beam[got], ids[got]])
        all_f = np.hstack([fresh[got], ids[got] >= 0])
        top = np.argpartition(-all_s, BEAM - 1, axis=1)[:, :BEAM]
        score[got], beam[got], fresh[got] = (np.take_along_axis(a, top, 1) for a in (all_s, all_i, all_f))
    return beam, seen, hits


def medoids_of(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The member nearest to the mean of each of some sampled clusters."""
    n = len(x)
    picked = rng.choice(n, max(1, n // PER_MEDOID), replace=False)
    own = (x @ x[picked].T).argmax(1)
    out = []
    for k in range(len(picked)):
        members = np.flatnonzero(own == k)
        if len(members):
            out.append(members[(x[members] @ x[members].mean(0)).argmax()])
    return np.unique(np.array(out, np.int64))


def build_graph(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Lists (padded with -1) of float32 unit vectors, and the medoids that searches start from."""
    n = len(x)
    rng = np.random.default_rng(seed)
    medoids = medoids_of(x, rng)
    rest = np.setdiff1d(np.arange(n), medoids)
    order = np.concatenate([medoids, rng.permutation(rest)])
    lists = np.full((n, WIDTH), -1, np.int64)
    done = 0
    while done < n:
        size = min(BATCH, max(len(medoids), done), n - done) or 1
        new = order[done : done + size]
        inside = x[new] @ x[new].T
        np.fill_diagonal(inside, -3)
        k = min(POOL // 2, size)
        cand = new[np.argpartition(-inside, k - 1, axis=1)[:, :k]]
        if done:
            beam, _, _ = walk(x, lists, medoids, new)
            cand = np.hstack([cand, beam])
        kept = pruned(x, new, cand)
        lists[new, :DEGREE] = kept
        # reverse edges; a list that outgrows its width is pruned anew
        r, c = np.nonzero(kept >= 0)
        back, to = new[r], kept[r, c]
        by = np.argsort(to, kind="stable")
        back, to = back[by], to[by]
        ends, first, count = np.unique(to, return_index=True, return_counts=True)
        more = np.full((len(ends), int(count.max()) if len(ends) else 0), -1, np.int64)
        more[np.repeat(np.arange(len(ends)), count), np.arange(len(to)) - np.repeat(first, count)] = back
        both = np.hstack([lists[ends], more])
        # left-packed, each once
        both = -np.sort(-both, axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        both = -np.sort(-both, axis=1)
        full = (both >= 0).sum(1) > WIDTH
        lists[ends[~full]] = both[~full][:, :WIDTH] if both.shape[1] >= WIDTH else np.pad(both[~full], ((0, 0), (0, WIDTH - both.shape[1])), constant_values=-1)
        if full.any():
            lists[ends[full]] = -1
            lists[ends[full], :DEGREE] = pruned(x, ends[full], both[full])
        done += size
    return lists, medoids


def range_search(x: np.ndarray, lists: np.ndarray, medoids: np.ndarray, queries: np.ndarray, threshold: float):
    """(query, vector) pairs whose float32 cosine is about the threshold or more, itself left out."""
    n = len(x)
    above = np.float32(threshold - 1e-5)
    found = []
    for lo in range(0, len(queries), BATCH):
        qs = queries[lo : lo + BATCH]
        _, seen, hits = walk(x, lists, medoids, qs, above)
        front = np.unique(np.concatenate([h[0] * n + h[1] for h in hits]))
        # a query is a vector of the graph: it lies in its own range
        front = np.union1d(front, np.arange(len(qs)) * n + qs)
        seen[np.arange(len(qs)), qs] = True
        inside = [front]
        while len(front):
            new = []
            for k in range(0, len(front), 100_000):
                r, v = front[k : k + 100_000] // n, front[k : k + 100_000] % n
                step = lists[v]
                r, v = np.repeat(r, step.shape[1]), step.ravel()
                ok = v >= 0
                r, v = r[ok], v[ok]
                ok = ~seen[r, v]
                code = np.unique(r[ok] * n + v[ok])
                r, v = code // n, code % n
                seen[r, v] = True
                new.append(code[np.einsum("ij,ij->i", x[qs[r]], x[v]) >= above])
            front = np.concatenate(new)
            inside.append(front)
        code = np.concatenate(inside)
        q, v = qs[code // n], code % n
        found.append((q[q != v], v[q != v]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def verified(x: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with a cosine of the threshold or more in double precision."""
    keep = [np.einsum("ij,ij->i", x[q[k : k + 200_000]], x[v[k : k + 200_000]]) >= THRESHOLD for k in range(0, len(q), 200_000)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return q[keep], v[keep]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each node's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


# ----------------------------------------------------------------- tables of cells

BUILT = "shard bigint, cls bigint, copies bigint, home boolean, embedding array<double>, medoid boolean, ends array<bigint>"
FOUND = "cls bigint, links bigint, root bigint, other bigint, copies bigint, copies_other bigint"


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """The graph of one cell: its classes with their lists, and for other cells of a class the
    near ends of its list that those lack: as rows there, with the class as their list."""
    pdf = pdf.sort_values("cls", kind="stable").reset_index(drop=True)
    x = unit(pdf["embedding"])
    lists, medoids = build_graph(x.astype(np.float32))
    cls = pdf["cls"].to_numpy()
    flag = np.zeros(len(pdf), bool)
    flag[medoids] = True
    here = pdf.assign(medoid=flag, ends=[cls[a[a >= 0]] for a in lists])
    u, k = np.nonzero(lists >= 0)
    v = lists[u, k]
    many = pdf["shards"].map(len).to_numpy() > 1
    u, v = u[many[u]], v[many[u]]
    near = np.einsum("ij,ij->i", x[u], x[v]) >= NEAR if len(u) else np.zeros(0, bool)
    shards = [set(s) for s in pdf["shards"]]
    out = [(s, a, b) for a, b in zip(u[near], v[near], strict=True) for s in shards[a] - shards[b]]
    cols = ["shard", "cls", "copies", "home", "embedding", "medoid", "ends"]
    if not out:
        return here[cols]
    there = pdf.iloc[[b for _, _, b in out]].assign(
        shard=[s for s, _, _ in out], home=False, medoid=False, ends=[[cls[a]] for _, a, _ in out]
    )
    return pd.concat([here[cols], there[cols]], ignore_index=True)


def search_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of the classes at home in one cell of the joined graph: a row for each with the
    links within and its root, and a row for each link that leads to a class at home elsewhere."""
    pdf = pdf.sort_values(["cls", "home", "medoid"], ascending=[True, False, False], kind="stable")
    one = pdf.drop_duplicates("cls").reset_index(drop=True)
    cls, copies, home = one["cls"].to_numpy(), one["copies"].to_numpy(), one["home"].to_numpy()
    x = unit(one["embedding"])
    n = len(one)
    sizes = pdf["ends"].map(len).to_numpy()
    a = np.searchsorted(cls, np.repeat(pdf["cls"].to_numpy(), sizes))
    b = np.searchsorted(cls, np.concatenate([np.asarray(e, np.int64) for e in pdf["ends"]])) if sizes.sum() else a
    code = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = code // n, code % n
    count = np.bincount(a, minlength=n)
    lists = np.full((n, max(1, int(count.max()))), -1, np.int64)
    lists[a, np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)] = b
    medoids = np.flatnonzero(one["medoid"].to_numpy())
    asked = np.flatnonzero(home)
    if n > 1 and len(asked):
        q, v = verified(x, *range_search(x.astype(np.float32), lists, medoids, asked, THRESHOLD))
    else:
        q = v = np.zeros(0, np.int64)
    # a link found from either end holds for both
    both = np.unique(np.concatenate([q * n + v, v * n + q]))
    q, v = both // n, both % n
    root = _roots(n, q, v)
    inside = home[q] & home[v]
    links = np.bincount(q[inside], copies[v[inside]], n).astype(np.int64)
    own = pd.DataFrame({"cls": cls[asked], "links": links[asked], "root": cls[root[asked]]})
    q, v = q[home[q] & ~home[v]], v[home[q] & ~home[v]]
    out = pd.DataFrame({"cls": cls[q], "links": 0, "root": cls[root[q]], "other": cls[v], "copies": copies[q], "copies_other": copies[v]})
    return pd.concat([own, out], ignore_index=True).reindex(columns=["cls", "links", "root", "other", "copies", "copies_other"]).astype(dict.fromkeys(("other", "copies", "copies_other"), "Int64"))


def pick_pivots(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sampled classes of a cell to its pivots: those within range of each other are one dense
    spot and become their mean, so that it is not cut up. Dense spots come first."""
    x = unit(pdf.sort_values("cls", kind="stable")["embedding"])
    found, size = [], []
    left = np.ones(len(x), bool)
    for i in range(len(x)):
        if left[i]:
            near = left & (x @ x[i] >= THRESHOLD)
            left &= ~near
            mean = x[near].mean(0)
            found.append(mean / np.linalg.norm(mean))
            size.append(int(near.sum()))
    order = np.argsort(-np.array(size), kind="stable")
    many = max(int((np.array(size) > 1).sum()), int(pdf["wanted"].iloc[0]))
    return pd.DataFrame({"cell": pdf["cell"].iloc[0], "pivots": [[found[i].tolist() for i in order[:many]]]})


def deal(key: tuple, members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """A bucket of a cell's classes to the cells of its pivots. A class at home goes to the
    nearest, its new home, and to those that are nearly as near; a guest to the nearest."""
    if not len(members):
        return members.assign(place=0, near=0.0)[DEALT]
    p = np.array([list(v) for v in pivots["pivots"].iloc[0]], np.float64)
    s = unit(members["embedding"]) @ p.T
    order = np.argsort(-s, axis=1, kind="stable")[:, :OVERLAP]
    best = np.take_along_axis(s, order, 1)
    parts = []
    for k in range(order.shape[1]):
        rows = np.ones(len(members), bool) if k == 0 else members["home"].to_numpy() & (best[:, k] >= best[:, 0] - MARGIN)
        some = members[rows].assign(place=order[rows, k], near=best[rows, k])
        parts.append(some if k == 0 else some.assign(home=False))
    return pd.concat(parts, ignore_index=True)[DEALT]


DEALT = ["cell", "cls", "copies", "home", "embedding", "place", "near"]
DEALT_TYPES = "cell bigint, cls bigint, copies bigint, home boolean, embedding array<double>, place int, near double"


def cells_of(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Classes (cls, copies, embedding, label, dim) to the rows of small cells (cell, cls,
    copies, home, embedding) and those of dense spots (with ``near``, the cosine to the centre)."""
    rows = classes.select(F.xxhash64("label", "dim").alias("cell"), "cls", "copies", F.lit(True).alias("home"), "embedding")
    small, dense, level = [], [], 0
    while True:
        sizes = written(rows.groupBy("cell").agg(F.count("*").alias("m"), F.min("cls").alias("least")), "vector-cells")
        large = sizes.where(F.col("m") > SHARD)
        if large.isEmpty():
            small.append(rows)
            break
        small.append(rows.join(large, "cell", "left_anti"))
        wanted = F.least(F.lit(PIVOTS), F.ceil(F.col("m") * 2 / SHARD)).cast("int")
        big = rows.join(large.withColumn("wanted", wanted), "cell")
        every = F.greatest(F.lit(1), F.floor(F.col("m") / (F.col("wanted") * SAMPLED)))
        picked = (F.pmod(F.xxhash64("cls", F.lit(level)), every) == 0) | (F.col("cls") == F.col("least"))
        sample = big.where(picked).select("cell", "cls", "embedding", "wanted")
        pivots = written(sample.groupBy("cell").applyInPandas(pick_pivots, "cell bigint, pivots array<array<double>>"), "vector-pivots")
        # buckets of a cell are dealt apart, each with the cell's pivots
        buckets = F.ceil(F.col("m") / BUCKET).cast("int")
        left = big.withColumn("bucket", F.pmod(F.xxhash64("cls"), buckets).cast("int")).drop("m", "least", "wanted")
        right = pivots.join(large, "cell").select("cell", F.explode(F.sequence(F.lit(0), buckets - 1)).alias("bucket"), "pivots")
        dealt = left.groupBy("cell", "bucket").cogroup(right.groupBy("cell", "bucket")).applyInPandas(deal, DEALT_TYPES)
        dealt = written(dealt.join(pivots.select("cell", (F.size("pivots") == 1).alias("single")), "cell"), "vector-dealt")
        spots = dealt.where("single")
        if not spots.isEmpty():
            dense.append(spots.drop("single", "place"))
        rows = dealt.where("not single").withColumn("cell", F.xxhash64("cell", "place", F.lit(level))).drop("single", "place", "near")
        level += 1
    union = lambda dfs: None if not dfs else dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    return union(small), union(dense)


def compare_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Outer vectors of a dense spot against one block of it: links, each pair of two outer
    vectors only from its lesser one."""
    ask, has = pdf[pdf["asks"]].reset_index(drop=True), pdf[~pdf["asks"]].reset_index(drop=True)
    out = []
    if len(ask) and len(has):
        s = unit(ask["embedding"]) @ unit(has["embedding"]).T >= THRESHOLD
        a, b = ask["cls"].to_numpy(), has["cls"].to_numpy()
        s &= ~((has["near"].to_numpy() < HALF)[None, :] & (a[:, None] >= b[None, :]))
        ha, hb = ask["home"].to_numpy(), has["home"].to_numpy()
        ca, cb = ask["copies"].to_numpy(), has["copies"].to_numpy()
        inside = (s & ha[:, None] & hb[None, :]).astype(np.float64)
        i, j = np.nonzero(s)
        cls, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = cls[_roots(len(cls), at[i], at[len(a) + j])]
        out.append(pd.DataFrame({"cls": a, "links": (inside @ cb).astype(np.int64), "root": root[at[: len(a)]]}))
        out.append(pd.DataFrame({"cls": b, "links": (ca @ inside).astype(np.int64), "root": root[at[len(a) :]]}))
        i, j = np.nonzero(s & (ha[:, None] != hb[None, :]))
        out.append(pd.DataFrame({"cls": a[i], "links": 0, "root": b[j], "other": b[j], "copies": ca[i], "copies_other": cb[j]}))
    cols = ["cls", "links", "root", "other", "copies", "copies_other"]
    got = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=cols)
    return got.reindex(columns=cols).astype(dict.fromkeys(cols, "Int64"))


def dense_links(spots: DataFrame) -> DataFrame:
    """Links in dense spots, as rows of FOUND."""
    core = spots.where((F.col("near") >= HALF) & F.col("home"))
    sums = core.groupBy("cell").agg(F.sum("copies").alias("all"), F.min("cls").alias("least"))
    none = [F.lit(None).cast("bigint").alias(c) for c in ("other", "copies", "copies_other")]
    certain = core.join(sums, "cell").select("cls", (F.col("all") - F.col("copies")).alias("links"), F.col("least").alias("root"), *none)
    outer = (F.col("near") < HALF) | ~F.col("home")
    spots = spots.withColumn("near", F.when(F.col("home"), F.col("near")).otherwise(F.lit(-1.0)))
    blocks = spots.groupBy("cell").agg(
        F.ceil(F.count_if(outer) / SHARD).alias("asking"), F.ceil(F.count("*") / SHARD).alias("having")
    )
    placed = spots.join(blocks.where("asking > 0"), "cell").withColumn("h", F.xxhash64("cls"))
    kept = ["cell", "cls", "copies", "home", "embedding", "near"]
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - F.lit(1).cast("bigint")))
    ask = placed.where(outer).select(*kept, F.lit(True).alias("asks"), F.pmod("h", F.col("asking")).alias("i"), upto("having").alias("j"))
    has = placed.select(*kept, F.lit(False).alias("asks"), upto("asking").alias("i"), F.pmod("h", F.col("having")).alias("j"))
    return certain.unionByName(ask.unionByName(has).groupBy("cell", "i", "j").applyInPandas(compare_blocks, FOUND))


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding, label, ...)``.

    Vectors link when their labels are equal and not null and the cosine is 0.93 or more.
    Those that are null, empty, zero, or hold null or non-finite components link with nothing,
    nor do vectors of different lengths. Repeated rows link with each other; rows with one
    vec_id are one vector of the component but each counts as a link. A null vec_id has no
    component. An empty table gives an empty result; other columns are ignored. The graph is
    approximate: ``audit_recall`` measures it; no false link is given.
    """
    base = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        # one spelling of zero, so that equal vectors are equal keys
        F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0)).alias("embedding"),
    )
    good = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    fit = base.where(good).select("vec_id", "label", "embedding", F.size("embedding").alias("dim"))
    classes = written(
        fit.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("cls"), F.count("*").alias("copies")), "vector-classes"
    )
    # a vec_id that stands in several rows may name several classes
    clash = classes.groupBy("cls").count().where("count > 1")
    if not clash.isEmpty():
        return _with_clashes(base, good)
    small, dense = cells_of(classes)
    where = small.groupBy("cls").agg(F.collect_set("cell").alias("shards"))
    built = written(
        small.withColumnRenamed("cell", "shard").join(where, "cls").groupBy("shard").applyInPandas(build_shard, BUILT), "vector-graph"
    )
    found = built.groupBy("shard").applyInPandas(search_shard, FOUND)
    found = written(found if dense is None else found.unionByName(dense_links(dense)), "vector-links")
    across = found.where("other is not null").select(
        F.least("cls", "other").alias("a"),
        F.greatest("cls", "other").alias("b"),
        F.when(F.col("cls") < F.col("other"), F.col("copies")).otherwise(F.col("copies_other")).alias("na"),
        F.when(F.col("cls") < F.col("other"), F.col("copies_other")).otherwise(F.col("copies")).alias("nb"),
    ).distinct()
    ends = F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("nb").alias("links")), F.struct(F.col("b").alias("cls"), F.col("na").alias("links"))))
    links = found.where("other is null").select("cls", "links").unionByName(across.select(ends.alias("e")).select("e.*"))
    links = links.groupBy("cls").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")).unionByName(across.select("a", "b")))
    of_class = (
        classes.join(links, "cls", "left")
        .join(component, classes["cls"] == component["node"], "left")
        .select(
            _digest(F.col("label"), F.col("embedding")).alias("digest"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "cls").alias("component_id"),
        )
    )
    return base.withColumn("digest", F.when(good, _digest(F.col("label"), F.col("embedding")))).join(of_class, "digest", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )


def _digest(label: Column, embedding: Column) -> Column:
    """128 bits that stand for a label and a vector where they are joined."""
    return F.struct(F.xxhash64(label, embedding).alias("a"), F.xxhash64(embedding, F.lit(1), label).alias("b"))


def _with_clashes(base: DataFrame, good: Column) -> DataFrame:
    """Where one vec_id names several vectors: rows get numbers of their own for the search, and
    the components are joined again over rows that share a vec_id."""
    numbered = written(base.withColumn("row", F.monotonically_increasing_id()), "vector-rows")
    usable_rows = numbered.where(good)
    got = written(near_vectors(usable_rows.select(F.col("row").alias("vec_id"), "label", "embedding")).withColumnRenamed("vec_id", "row"), "vector-by-row")
    ids = usable_rows.select("row", "vec_id")
    lead = ids.select(F.col("row").alias("component_id"), F.col("vec_id").alias("lead"))
    joined = got.join(ids, "row").join(lead, "component_id")
    component = connected_components(joined.select(F.col("vec_id").alias("a"), F.col("lead").alias("b")))
    rows = numbered.join(got.select("row", "n_links"), "row", "left").join(component, numbered["vec_id"] == component["node"], "left")
    own = F.when(good, F.coalesce("component", "vec_id")).otherwise(F.col("vec_id"))
    return rows.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"),
    )


def audit_recall(vectors: DataFrame, result: DataFrame, every: int = 50) -> tuple[float, int]:
    """Against brute force for the vectors whose id is divisible by ``every``, compared with all
    rows in blocks of queries: the part of the true links that ``result`` counts for them, never
    more for a vector than it has, and the number of links that are counted but not true."""
    spark = vectors.sparkSession
    good = vectors.where(usable(F.col("embedding")) & F.col("label").isNotNull())
    asked = good.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "label", "embedding").toLocalIterator()
    counts = None
    while some := list(itertools.islice(asked, 2000)):
        shared = spark.sparkContext.broadcast(([r["vec_id"] for r in some], np.array([r["label"] for r in some]), unit([r["embedding"] for r in some])))

        def count(it, shared=shared):
            ids, labels, q = shared.value
            n = np.zeros(len(ids), np.int64)
            for pdf in it:
                n += ((q @ unit(pdf["embedding"]).T >= THRESHOLD) & (labels[:, None] == pdf["label"].to_numpy()[None, :])).sum(1)
            yield pd.DataFrame({"vec_id": ids, "n": n})

        part = good.select("label", "embedding").mapInPandas(count, "vec_id bigint, n bigint")
        counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        return 1.0, 0
    # a query counts itself once
    true = counts.groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
    both = true.join(result.select("vec_id", "n_links"), "vec_id", "left").agg(
        F.sum("n"), F.sum(F.least("n", F.coalesce("n_links", F.lit(0)))), F.sum(F.greatest(F.col("n_links") - F.col("n"), F.lit(0)))
    ).first()
    return (both[1] / both[0] if both[0] else 1.0), both[2] or 0

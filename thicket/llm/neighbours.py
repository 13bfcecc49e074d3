"""The most similar vectors of every vector.

An inverted file of coarse centroids with product-quantised residuals. Each vector belongs to
the list of its nearest centroid and is stored there with an 16-byte code: its residual cut into 16
parts, each replaced by the nearest of 256 codewords. A query builds, for every part, a table of the
inner products with all codewords; the approximate similarity to a stored vector is the similarity to
its centroid plus sixteen table entries (asymmetric distance: the query itself is never quantised).
The best candidates of the approximate order are reranked with the exact vectors, which lie in the
same list, so nothing has to be fetched.

Centroids and codewords are fitted on a bounded sample (``SAMPLE`` vectors chosen by a hash); every
vector is indexed. The number of lists grows with the number of vectors: up to ``CELLS_FITTED`` cells have a
centroid of their own, and where more lists are wanted each cell is cut by the nearest of R fine centroids of the
residuals, so R times as many lists come from the same sample. Near cells are put into groups, and a group with
more vectors than a block of about ``BLOCK_ROWS`` is cut into blocks along its fine lists. A query travels only to the
blocks that hold a list it probes, so its copies are at most the lists it probes, and the memory of a task does not grow
with the number of vectors. (Only a list that alone is longer than a block lies in several, all of which are visited:
none of its vectors is left out.)

``probes`` lists are probed for a query. With ``min_cosine`` only pairs at least that similar are kept, every
candidate that the approximate similarity does not rule out is compared exactly, and few probes suffice, since so near
a vector lies in the same or an adjacent list; a pair found from one side counts for both. Without it the best
``rerank * k`` candidates by approximate similarity are compared exactly. A vector that a large share of
the rows have exactly (a bounded number of such vectors exists) is searched once for all of them. The share of misses is measured in the tests against brute force.

Vectors that are null, of another length, with a null or non-finite number, or all zero take no part. Several rows
with one id (blanks around it and letter case ignored, and so returned) are one vector, the lowest sequence. Ties in similarity are broken by id. Equal vectors of
different ids are neighbours of similarity 1. A list that many vectors share is cut into blocks, so
none is left out. Fewer than k others: as many as there are. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.keys import key
from thicket.operators.skew import heavy_keys, task_labels
from thicket.session import Scratch

#: Vectors that centroids and codewords are fitted on at most.
SAMPLE = 60_000
#: Vectors a list should hold.
LIST_ROWS = 400
#: Cells with a centroid of their own at most: the sample holds about 30 vectors for each. More lists come from fine centroids.
CELLS_FITTED = 2048
#: Vectors a block should hold at most.
BLOCK_ROWS = 10_000
PARTS, WORDS = 16, 256
#: What the approximate similarity may be too low by without a candidate being lost.
SLACK = 0.3
#: Queries searched together in a block.
QUERY_ROWS = 2000
#: Approximate similarities held in memory at once.
CELLS = 1 << 19
#: A vector that more than this share of the rows have is searched once for all of them.
HOT_SHARE = 0.005
#: Candidates reranked for each wanted neighbour.
RERANK = 20


def usable(vec: Column, dim: int) -> Column:
    """True for vectors of the right length with finite numbers, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vec) == dim) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, c, spherical)
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(k))
        n = np.bincount(at, minlength=k)
        sums = np.add.reduceat(np.vstack([x[order], np.zeros((1, x.shape[1]), np.float32)]), np.minimum(first, len(x)), axis=0)
        full = n > 0
        c[full] = sums[full] / n[full, None]
        c[~full] = x[rng.integers(0, len(x), int((~full).sum()))]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, spherical: bool) -> np.ndarray:
    half = 0.0 if spherical else (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ c.T - half, axis=1) for i in range(0, len(x), 8192)])


class Model:
    """Centroids of cells, fine centroids of what is left, the group of each cell, and the codewords of each part.

    A list is (cell, fine centroid), numbered cell * R + fine.
    """

    def __init__(self, sample: np.ndarray, lists: int, groups: int, parts: int = PARTS, seed: int = 7, cells: int = CELLS_FITTED):
        rng = np.random.default_rng(seed)
        wanted = max(1, lists)
        lists = max(1, min(lists, cells, len(sample)))
        self.centroids = _kmeans(sample, lists, 8, rng, True)
        at = _nearest(sample, self.centroids, True)
        rest = sample - self.centroids[at]
        self.parts = parts
        d = sample.shape[1] // parts
        part = rest[:30_000]
        fine = max(1, min(-(-wanted // lists) if wanted > lists else 1, len(part)))
        self.fine = np.zeros((1, sample.shape[1]), np.float32) if fine == 1 else _kmeans(part, fine, 8, rng, False)
        # half the square of each centre's length
        self.half = ((self.centroids**2).sum(axis=1)[:, None] + (self.fine**2).sum(axis=1)[None, :]) / 2 + self.centroids @ self.fine.T
        part = part - self.fine[_nearest(part, self.fine, False)]
        self.words = np.stack([_kmeans(np.ascontiguousarray(part[:, p * d : (p + 1) * d]), min(WORDS, len(part)), 6, rng, False) for p in range(parts)])
        # near cells share a group; groups get about the same number of sampled vectors
        seeds = _kmeans(self.centroids, max(1, min(groups, lists)), 8, rng, True)
        load = np.bincount(at, minlength=lists).astype(float)
        room = np.full(len(seeds), 1.15 * load.sum() / len(seeds) + load.max())
        pref = np.argsort(-(self.centroids @ seeds.T), axis=1)
        self.group = np.zeros(lists, np.int32)
        for c in np.argsort(-load, kind="stable"):
            g = next((g for g in pref[c] if room[g] >= load[c]), pref[c][0])
            self.group[c] = g
            room[g] -= load[c]
        self.load = np.bincount(self.group[at], minlength=len(seeds)).astype(float)

    def centre(self, at: np.ndarray) -> np.ndarray:
        """The centre of each list."""
        return self.centroids[at // len(self.fine)] + self.fine[at % len(self.fine)]

    def home(self, x: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """The list of each vector, given its similarities to the centroids."""
        cell = np.argmax(sims, axis=1)
        if len(self.fine) == 1:
            return cell
        return cell * len(self.fine) + _nearest(x - self.centroids[cell], self.fine, False)

    def near(self, x: np.ndarray, sims: np.ndarray, probes: int) -> np.ndarray:
        """(query, list): the ``probes`` lists whose centres are nearest, out of those of as many cells."""
        k = min(probes, sims.shape[1])
        cells = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        r = len(self.fine)
        if r == 1:
            return cells
        out = []
        for a in range(0, len(x), 1024):
            c = cells[a : a + 1024]
            s = np.take_along_axis(sims[a : a + 1024], c, axis=1)[:, :, None] + (x[a : a + 1024] @ self.fine.T)[:, None, :] - self.half[c]
            s = s.reshape(len(c), -1)
            best = np.argpartition(-s, min(probes, s.shape[1]) - 1, axis=1)[:, :probes]
            out.append(np.take_along_axis(c, best // r, axis=1) * r + best % r)
        return np.concatenate(out)

    def codes(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        rest = x - self.centre(at)
        d = x.shape[1] // self.parts
        return np.stack([_nearest(np.ascontiguousarray(rest[:, p * d : (p + 1) * d]), self.words[p], False) for p in range(self.parts)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(query, part, codeword): inner products of the query's parts with the codewords."""
        d = q.shape[1] // self.parts
        return np.stack([q[:, p * d : (p + 1) * d] @ self.words[p].T for p in range(self.parts)], axis=1)


class Layout:
    """Where the lists of each group lie: ``wanted`` blocks, cut along the fine lists as far as there are any."""

    def __init__(self, model: Model, wanted: np.ndarray):
        self.fine = len(model.fine)
        self.group = model.group
        self.chunks = np.minimum(wanted, self.fine)
        #: blocks that each chunk is dealt to by row number; 1 unless a single fine list is longer than a block
        self.slices = -(-wanted // self.chunks)
        self.first = np.concatenate([[0], np.cumsum(self.chunks * self.slices)])
        self.total = int(self.first[-1])
        #: a number for each block whose hash leads to a task of its own
        self.labels = np.arange(self.total)

    def base(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First block of each list and the number of blocks it lies in."""
        g = self.group[lists // self.fine]
        chunk = (lists % self.fine) * self.chunks[g] // self.fine
        return self.first[g] + chunk * self.slices[g], self.slices[g]


def _route(model: Model, probes: int, layout: Layout):
    """Index rows for the home block of a vector, query rows for every other block it has to visit."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = _unit(pdf["vec"])
            sims = x @ model.centroids.T
            home = model.home(x, sims)
            seq, asked = pdf["seq"].to_numpy(np.int64), pdf["asked"].to_numpy(bool)
            base, n = layout.base(home)
            home_block = base + seq % n
            # every (query, block, list) that has to meet
            who = np.flatnonzero(asked)
            lists = model.near(x[who], sims[who], probes) if len(who) else np.zeros((0, 1), int)
            rows, flat = np.repeat(who, lists.shape[1]), lists.ravel().astype(np.int64)
            base, n = layout.base(flat)
            each = np.repeat(np.arange(len(flat)), n)
            block = base[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            rows, flat = rows[each], flat[each]
            order = np.lexsort((flat, block, rows))
            rows, block, flat = rows[order], block[order], flat[order].astype("<u4")
            cut = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (block[1:] != block[:-1])]) if len(rows) else np.zeros(0, int)
            ends, data = np.append(cut[1:], len(rows)), flat.tobytes()
            lists_of = np.array([data[4 * a : 4 * b] for a, b in zip(cut, ends)] + [None], object)[:-1]
            rows, block = rows[cut], block[cut]
            here = block == home_block[rows]
            own = np.full(len(x), b"", object)
            own[rows[here]] = lists_of[here]
            r = np.concatenate([np.arange(len(x)), rows[~here]])
            vec = np.array([v.tobytes() for v in x] + [None], object)[:-1]
            ids = pdf["id"].to_numpy()
            at = np.concatenate([home_block, block[~here]])
            yield pd.DataFrame({
                "task": layout.labels[at].astype(np.int32), "block": at.astype(np.int32), "id": ids[r], "seq": seq[r], "list": home[r].astype(np.int32),
                "stored": np.arange(len(r)) < len(x), "asked": asked[r], "vec": vec[r], "probe": np.concatenate([own, lists_of[~here]]),
            })

    return f


def _search(model: Model, k: int, min_cosine: float | None, rerank: int, slack: float, both_ways: bool):
    """Neighbours within one block: (q, id, cosine), at most k for each query."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "seq"], kind="stable")
        # rows of one id are one vector
        stored = pdf[pdf["stored"]].drop_duplicates("id")
        queries = pdf[pdf["asked"]].drop_duplicates("id")
        if not len(stored) or not len(queries):
            return pd.DataFrame({"q": [], "id": [], "cosine": []}).astype({"q": object, "id": object, "cosine": float})
        # places of the ids in their order, by which ties are broken
        stored, queries = stored.assign(place=np.arange(len(stored))).sort_values("list", kind="stable"), queries.sort_values("list", kind="stable")
        place = stored["place"].to_numpy()
        ids, qids = stored["id"].to_numpy(), queries["id"].to_numpy()
        x = np.frombuffer(b"".join(stored["vec"]), np.float32).reshape(len(stored), -1)
        q = np.frombuffer(b"".join(queries["vec"]), np.float32).reshape(len(queries), -1)
        probe = queries["probe"].to_numpy()
        lists = stored["list"].to_numpy()
        codes = model.codes(x, lists)
        own, start = np.unique(lists, return_index=True)
        end = np.append(start[1:], len(lists))
        keep = rerank * k
        out = pd.concat([search(q, qids, probe, ids, place, x, codes, own, start, end, keep, a) for a in range(0, len(q), QUERY_ROWS)])
        if both_ways:
            out = pd.concat([out, out.rename(columns={"q": "id", "id": "q"})[["q", "id", "cosine"]]])
            out = out.drop_duplicates(["q", "id"]).sort_values(["q", "cosine", "id"], ascending=[True, False, True], kind="stable")
            out = out[out.groupby("q").cumcount() < k]
        return out

    def best_of(q, qids, ids, place, x, fq: np.ndarray, fx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs (query, vector) the k most similar of each query by the exact cosine, of equal ones the first id."""
        other = qids[fq] != ids[fx]
        fq, fx = fq[other], fx[other]
        cos = np.concatenate([np.einsum("ij,ij->i", q[fq[i : i + 65536]].astype(np.float64), x[fx[i : i + 65536]].astype(np.float64)) for i in range(0, len(fq), 65536)] or [np.zeros(0)])
        if min_cosine is not None:
            ok = cos >= min_cosine
            fq, fx, cos = fq[ok], fx[ok], cos[ok]
        if not len(fq):
            return fq, fx, cos
        return first_k(place, fq, fx, cos)

    def first_k(place, fq: np.ndarray, fx: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((place[fx], -cos, fq))
        fq, fx, cos = fq[order], fx[order], cos[order]
        top = np.arange(len(fq)) - np.searchsorted(fq, fq) < k
        return fq[top], fx[top], cos[top]

    def search(q, qids, probe, ids, place, x, codes, own, start, end, keep: int, at: int) -> pd.DataFrame:
        """The neighbours of ``QUERY_ROWS`` queries from row ``at`` on."""
        q, qids, probe = (v[at : at + QUERY_ROWS] for v in (q, qids, probe))
        # queries of each list
        flat = np.frombuffer(b"".join(probe), "<u4").astype(np.int64)
        who = np.repeat(np.arange(len(q)), [len(v) // 4 for v in probe])
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], who[order]
        lo, hi = np.searchsorted(flat, own), np.searchsorted(flat, own, "right")
        tables = model.tables(q)
        found_q, found_x, found_s = [], [], []
        # the best approximate similarities of each query so far, and the least of them
        best, bar = np.full((len(q), 0 if min_cosine is not None else keep), -np.inf, np.float32), np.full(len(q), -np.inf, np.float32)
        for li, c in enumerate(own):
            mine = who[lo[li] : hi[li]]
            part = codes[start[li] : end[li]]
            chunk = max(1, min(2048, CELLS // len(part)))
            for a in range(0, len(mine), chunk):
                sub = mine[a : a + chunk]
                table = tables[sub]
                score = np.repeat((q[sub] @ model.centre(np.array([c]))[0])[:, None], len(part), axis=1)
                for p in range(model.parts):
                    score += np.take(table[:, p], part[:, p], axis=1)
                if min_cosine is not None:
                    # all that may be close enough are compared exactly, and the k best of the list stay
                    r, s = np.nonzero(score >= min_cosine - slack)
                    r, s, cos = best_of(q, qids, ids, place, x, sub[r], s + start[li])
                    found_q.append(r)
                    found_x.append(s)
                    found_s.append(cos)
                    continue
                # only what is among the best so far can be among the best of all lists
                hit = score > bar[sub][:, None]
                r, s = np.nonzero(hit)
                if not len(r):
                    continue
                most = min(int(hit.sum(axis=1).max()), score.shape[1])
                fresh = np.partition(score, score.shape[1] - most, axis=1)[:, score.shape[1] - most :]
                both = np.concatenate([best[sub], fresh], axis=1)
                best[sub] = np.partition(both, both.shape[1] - keep, axis=1)[:, both.shape[1] - keep :]
                bar[sub] = best[sub].min(axis=1)
                value = score[r, s]
                among = value >= bar[sub[r]]
                found_q.append(sub[r[among]])
                found_x.append(s[among] + start[li])
                found_s.append(value[among])
        fq, fx, fs = (np.concatenate(v) if v else np.zeros(0, int) for v in (found_q, found_x, found_s))
        if min_cosine is None and len(fq):
            # the best of all lists by approximate similarity
            among = fs >= bar[fq]
            fq, fx, fs = fq[among], fx[among], fs[among]
            order = np.lexsort((-fs, fq))
            fq, fx = fq[order], fx[order]
            nth = np.arange(len(fq)) - np.searchsorted(fq, fq)
            fq, fx = fq[nth < keep], fx[nth < keep]
            fq, fx, fs = best_of(q, qids, ids, place, x, fq, fx)
        elif len(fq):
            fq, fx, fs = first_k(place, fq, fx, fs)
        return pd.DataFrame({"q": qids[fq], "id": ids[fx], "cosine": fs})

    return f


def _hot_vectors(good: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(vh, ids, seqs): of every vector that a large share of the rows have, the first k + 1 ids in
    order and the first row of each. Fewer than 1 / HOT_SHARE rows."""
    hot = scratch.save(heavy_keys(good.select("vh"), "vh", HOT_SHARE).where(F.col("load") > 2 * (k + 1)), "counts")
    own = good.join(F.broadcast(hot.select(F.col("key").alias("vh"))), "vh", "left_semi")
    first = own.groupBy("vh", "id").agg(F.min("seq").alias("seq"))
    order = Window.partitionBy("vh").orderBy("id")
    first = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    items = F.array_sort(F.collect_list(F.struct("id", "seq")))
    return first.groupBy("vh").agg(items.alias("m")).select("vh", F.col("m.id").alias("ids"), F.col("m.seq").alias("seqs"))


def neighbours(
    nodes: DataFrame,
    id_col: str,
    vec_col: str,
    seq_col: str,
    k: int = 10,
    dim: int = 64,
    probes: int = 64,
    min_cosine: float | None = None,
    queries: Column | None = None,
    sample: int = SAMPLE,
    parts: int = PARTS,
    rerank: int = RERANK,
    slack: float = SLACK,
    list_rows: int = LIST_ROWS,
    block_rows: int = BLOCK_ROWS,
    cells: int = CELLS_FITTED,
) -> DataFrame:
    """(q, id, cosine, place): for every query its k most similar other vectors, place 1 the nearest.

    ``queries`` restricts which rows ask (all rows are always indexed).
    """
    spark = nodes.sparkSession
    ask = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows = nodes.where(key(id_col).isNotNull()).select(key(id_col).alias("id"), F.col(seq_col).cast("long").alias("seq"), ask.alias("asked"), F.col(vec_col).alias("vec"))
    good = rows.where(usable(F.col("vec"), dim)).withColumn("vh", F.xxhash64("vec"))
    scratch = Scratch(spark, "neighbours")
    shared = scratch.save(_hot_vectors(good, k, scratch), "hot")
    marked = good.join(F.broadcast(shared), "vh", "left")
    # copies beyond the first k + 1 of a hot vector have those as neighbours and need no search
    easy = marked.where(F.col("ids").isNotNull() & F.col("asked") & ~F.coalesce(F.array_contains("ids", F.col("id")), F.lit(False)))
    easy = easy.select(F.col("id").alias("q"), F.explode(F.slice("ids", 1, k)).alias("id"), F.lit(1.0).alias("cosine")).distinct()
    good = marked.where(F.col("ids").isNull() | F.array_contains("seqs", F.col("seq"))).drop("ids", "seqs", "vh")
    count = good.count()
    lists = int(max(1, 2 ** round(np.log2(max(1, count / list_rows)))))
    groups = max(1, -(-count // block_rows))
    share = min(1.0, 1.2 * sample / max(1, count))
    taken = good.where(F.pmod(F.xxhash64("id", "seq"), F.lit(1 << 20)) < int(share * (1 << 20))).select("id", "vec").limit(sample)
    chosen = taken.toPandas().sort_values("id", kind="stable")
    if not len(chosen):
        return spark.createDataFrame([], "q string, id string, cosine double, place int")
    model = Model(_unit(chosen["vec"]), lists, groups, parts, cells=cells)
    layout = Layout(model, np.maximum(1, np.ceil(model.load / model.load.sum() * count / (1.5 * block_rows)).astype(int)))
    layout.labels = np.array(task_labels(spark, layout.total))
    schema = "task int, block int, id string, seq long, list int, stored boolean, asked boolean, vec binary, probe binary"
    routed = good.mapInPandas(_route(model, probes, layout), schema)
    # a task for each block: none grows with the data, and no two blocks meet in one by chance
    routed = routed.repartition(layout.total, "task")
    near = routed.groupBy("task", "block").applyInPandas(_search(model, k, min_cosine, rerank, slack, min_cosine is not None and queries is None), "q string, id string, cosine double")
    # the lists of a query from all blocks, cut to k; a query has at most k rows from each block it visits
    near = near.unionByName(easy)
    items = F.sort_array(F.collect_set(F.struct((-F.col("cosine")).alias("d"), "id")))
    best = near.groupBy("q").agg(F.slice(items, 1, k).alias("best"))
    out = best.select("q", F.posexplode("best").alias("place", "b"))
    return out.select("q", F.col("b.id").alias("id"), (-F.col("b.d")).alias("cosine"), (F.col("place") + 1).alias("place"))


def mutual(near: DataFrame, min_cosine: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs that are among each other's neighbours."""
    close = near.where(F.col("cosine") >= min_cosine)
    pairs = close.select(F.least("q", "id").alias("id_a"), F.greatest("q", "id").alias("id_b"), (F.col("q") < F.col("id")).alias("up")).distinct()
    return pairs.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("id_a", "id_b")

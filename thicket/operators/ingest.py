"""Items folded into branches.

Where the branch of an item is given, its running mean is a linear recurrence and is computed in closed
form by one aggregate. What cannot be written that way (the allocation of items to branches, in
which each decision reads what the one before wrote) is a fold of one ordered group, and is stated as
such: it is serial by nature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.config import EPS, Config
from thicket.functions import vectors as V
from thicket.operators.lineage import ordered
from thicket.session import Scratch, parallelism


def running_mean(nodes: DataFrame, dim: int, rho: float = 0.05) -> DataFrame:
    """(branch_id, n, mean_vec) after all items of a branch in order (timestamp, ingest_seq).

    mu_1 = x_1, mu_k = (1 - rho / (k+0)) mu_{k-1} + rho / k x_k, so the weight of item j is rho / j times the
    product of (1 - rho / i) over i > j; with gamma functions the product is a difference of two
    sums of logarithms, log(1 - rho/i) summed from j+1 to n, which the rank of an item and the size of
    its branch give without a sort.
    """
    rows = nodes.where(V.usable(F.col("embedding"), dim)).select("branch_id", "id", "timestamp", "ingest_seq", V.doubles("embedding").alias("x"))
    ranks = ordered(rows.drop("x")).select("ingest_seq", "rank")
    total = rows.where("branch_id IS NOT NULL").groupBy("branch_id").agg(F.count(F.lit(1)).alias("n"))
    placed = rows.join(ranks, "ingest_seq").join(total, "branch_id")
    # product over i = j+1 ... n of (i - rho) / i  =  G(n+1-rho) G(j+1) / (G(j+1-rho) G(n+1))
    lg = lambda c: _log_gamma_ratio(c, rho)
    product = F.exp(lg(F.col("n")) - lg(F.col("rank")))
    w = F.when(F.col("rank") == 1, 1.0).otherwise(F.lit(rho) / F.col("rank")) * product
    placed = placed.withColumn("_w", w)
    return placed.groupBy("branch_id").agg(F.first("n").alias("n"), F.array(*[F.sum(F.col("_w") * F.col("x")[i]) for i in range(dim)]).alias("mean_vec"))


def _log_gamma_ratio(k, rho: float):
    """log of the product over i = 2 ... k of (1 - rho / i): exact below 32, by Euler-Maclaurin above."""
    small = F.aggregate(F.sequence(F.lit(1), F.least(k, F.lit(32)).cast("int")), F.lit(0.0), lambda s, i: s + F.when(i > 1, F.log1p(-F.lit(rho) / i)).otherwise(0.0))
    # integral of log(1 - rho / x) from 32 to k, with the end corrections
    anti = lambda x: x * F.log1p(-F.lit(rho) / x) - rho * F.log(x - rho)
    f = lambda x: F.log1p(-F.lit(rho) / x)
    d1 = lambda x: rho / (x * (x - rho))
    d3 = lambda x: 2.0 / F.pow(x - rho, 3) - 2.0 / F.pow(x, 3)
    a, b = F.lit(32.0), F.greatest(k, F.lit(32)).cast("double")
    tail = anti(b) - anti(a) + (f(b) - f(a)) / 2 + (d1(b) - d1(a)) / 12 - (d3(b) - d3(a)) / 720
    return small + F.when(k > 32, tail).otherwise(0.0)


#: A move below this is rounding and counts as none.
LEAST_MOVE = 1e-12


class Branch:
    """State of one branch in the fold."""

    def __init__(self, x: np.ndarray):
        self.mean, self.anchor, self.cov = x.copy(), x.copy(), np.zeros_like(x)
        self.n, self.drift = 1, 0.0
        self.shape = self._spectrum(self.cov)
        self.ema = dict.fromkeys(("mu", "rank", "aniso", "trace"), 0.0)

    @staticmethod
    def _spectrum(v: np.ndarray) -> tuple[float, float, float]:
        mass = np.maximum(v, 0).sum() + EPS
        p = np.maximum(v, 0) / mass
        p = p[p > EPS]
        return float(np.exp(-(p * np.log(p + EPS)).sum())), float(v.max() / (v.sum() + EPS)), float(v.sum())

    def cosine(self, x: np.ndarray) -> float:
        return float(x @ self.mean / ((np.linalg.norm(x) + EPS) * (np.linalg.norm(self.mean) + EPS)))

    def strangeness(self, x: np.ndarray, conflict: float, cfg: Config) -> float:
        """How far the item would move the branch, against what moves are usual for it; the usual is updated."""
        n = max(self.n, 1)
        mean = (n * self.mean + x) / (n + 1)
        cov = (n * self.cov + (x - mean) ** 2) / (n + 1)
        old, new = self._spectrum(self.cov), self._spectrum(cov)
        moves = {"mu": float(np.linalg.norm(mean - self.mean)), "rank": abs(new[0] - old[0]), "aniso": abs(new[1] - old[1]), "trace": abs(new[2] - old[2])}
        weights = {"mu": cfg.gamma_mu, "rank": cfg.gamma_rank, "aniso": cfg.gamma_anisotropy, "trace": cfg.gamma_trace}
        total = cfg.gamma_semantic * (1 - self.cosine(x)) + cfg.gamma_conflict * conflict
        for k, d in moves.items():
            d = d if d > LEAST_MOVE else 0.0
            total += weights[k] * d / (self.ema[k] + EPS)
            self.ema[k] = d if self.ema[k] <= 0 else (1 - cfg.ema_rho) * self.ema[k] + cfg.ema_rho * d
        return total

    def add(self, x: np.ndarray, cfg: Config) -> None:
        m = (self.n * self.mean + x) / (self.n + 1)
        self.mean = (1 - cfg.ema_rho) * self.mean + cfg.ema_rho * m
        anchor = (1 - cfg.anchor_rho) * self.anchor + cfg.anchor_rho * m
        self.drift = float(np.linalg.norm(anchor - self.anchor))
        self.anchor, self.n = anchor, self.n + 1


def update_mode(action: str, branch_type: str, sim: float, conflict: float, forced: bool, cfg: Config) -> str:
    if action == "fork":
        return "fork"
    if branch_type in cfg.supersede_types and conflict >= cfg.supersede_conflict and sim >= cfg.supersede_sim:
        return "supersede"
    if conflict >= cfg.contradict_conflict:
        return "contradict"
    if sim >= cfg.refine_sim or (forced and conflict <= 0 and sim >= 0.5):
        return "refine"
    return "attach"


def inferred_type(node_type: Column) -> Column:
    """The type of a branch that a node begins (fixed values)."""
    return F.when(node_type == "message", "broad_history").when(node_type == "tool_result", "project_task").otherwise("default")


def mode_of(action: Column, branch_type: Column, sim: Column, conflict: Column, forced: Column, cfg: Config = Config()) -> Column:
    """``update_mode`` as a column."""
    replaces = F.coalesce(F.lower(F.trim(branch_type)).isin(list(cfg.supersede_types)), F.lit(False))
    return (
        F.when(action == "fork", "fork").when(replaces & (conflict >= cfg.supersede_conflict) & (sim >= cfg.supersede_sim), "supersede")
        .when(conflict >= cfg.contradict_conflict, "contradict").when((sim >= cfg.refine_sim) | (forced & (conflict <= 0) & (sim >= 0.5)), "refine").otherwise("attach")
    )


def _spectra(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Branch._spectrum of every row."""
    up = np.maximum(v, 0)
    p = up / (up.sum(axis=1, keepdims=True) + EPS)
    p = np.where(p > EPS, p, 0.0)
    total = v.sum(axis=1)
    return np.exp(-(p * np.log(p + EPS)).sum(axis=1)), v.max(axis=1) / (total + EPS), total


def strangeness_of(branches: list[Branch], x: np.ndarray, conflict: float, cfg: Config) -> np.ndarray:
    """Branch.strangeness of several branches at once; the usual moves of each are updated."""
    mean, cov = np.array([b.mean for b in branches]), np.array([b.cov for b in branches])
    n = np.array([max(b.n, 1) for b in branches], float)[:, None]
    moved = (n * mean + x) / (n + 1)
    step = moved - mean
    old, new = np.array([b.shape for b in branches]).T, _spectra((n * cov + (x - moved) ** 2) / (n + 1))
    moves = np.stack([np.sqrt((step * step).sum(axis=1)), *(np.abs(b - a) for a, b in zip(old, new))], axis=1)
    moves = np.where(moves > LEAST_MOVE, moves, 0.0)
    usual = np.array([list(b.ema.values()) for b in branches])
    cos = mean @ x / ((np.linalg.norm(x) + EPS) * (np.sqrt((mean * mean).sum(axis=1)) + EPS))
    weights = np.array([cfg.gamma_mu, cfg.gamma_rank, cfg.gamma_anisotropy, cfg.gamma_trace])
    total = cfg.gamma_semantic * (1 - cos) + cfg.gamma_conflict * conflict + (moves / (usual + EPS)) @ weights
    usual = np.where(usual <= 0, moves, (1 - cfg.ema_rho) * usual + cfg.ema_rho * moves)
    for b, u in zip(branches, usual.tolist()):
        b.ema = dict(zip(b.ema, u))
    return total


class Newest:
    """The branches touched last, at most ``size`` of them, as rows of one matrix."""

    def __init__(self, size: int):
        self.size, self.names, self.rows = size, [], {}
        self.mean, self.norm = None, np.zeros(size)
        self.n, self.stamp, self.touched = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)

    def put(self, name: str, b: Branch, turn: int, now: float) -> str | None:
        """Notes a branch as touched; returns the one that falls out for it."""
        if self.mean is None:
            self.mean = np.zeros((self.size, len(b.mean)))
        row, gone = self.rows.get(name), None
        if row is None:
            if len(self.names) < self.size:
                row = len(self.names)
                self.names.append(name)
            else:
                row = int(np.argmin(self.touched))
                gone, self.names[row] = self.names[row], name
                del self.rows[gone]
            self.rows[name] = row
        self.mean[row], self.norm[row], self.n[row] = b.mean, np.sqrt(b.mean @ b.mean), b.n
        self.stamp[row], self.touched[row] = now, turn
        return gone

    def best(self, k: int, active: str | None, now: float) -> list[str]:
        """TOP3: the k best by candidate score, the active branch first; of equal ones the newest."""
        m = len(self.names)
        if not m:
            return []
        n, stamp = self.n[:m], self.stamp[:m]
        # a branch of the fold has neither feedback nor a recomputed coherence: both are 0
        score = 0.10 * np.log1p(n) + np.where(stamp > 0, 0.20 / (1 + np.maximum(now - stamp, 0) / 86400), 0.0)
        a = self.rows.get(active)
        if a is not None:
            score = score + 0.55 * (self.mean[:m] @ self.mean[a]) / ((self.norm[:m] + EPS) * (self.norm[a] + EPS))
            score[a] = np.inf
        return [self.names[i] for i in np.lexsort((-self.touched[:m], -score))[:k]]


FOLD_SCHEMA = "item long, branch_id string, action string, score double, sim double, update_mode string, prev_item long, root_item long, version long, anchor_drift double"


class Fold:
    """Items taken one after the other: allocation, update mode, correction chain, geometry.

    Candidates of a free item are the best ten of the newest 128 branches by candidate score (TOP3); the active
    branch is the one that took the item before. With ``forget`` a branch beyond the newest 128 is dropped: no free
    item can reach it any more, so the state is bounded and the result the same.
    """

    def __init__(self, cfg: Config = Config(), candidates: int = 10, prefix: str = "conv_", newest: int = 128, forget: bool = False):
        self.cfg, self.candidates, self.prefix, self.forget = cfg, candidates, prefix, forget
        self.branches: dict[str, Branch] = {}
        self.last: dict[str, tuple[int, int, int]] = {}
        self.types: dict[str, str] = {}
        self.newest = Newest(newest)
        self.active: str | None = None
        self.turn, self.now = 0, 0.0
        self.fresh = 0

    def step(self, item: int, x: np.ndarray, conflict: float, branch_type: str, forced: str | None, ts: float | None = None) -> tuple:
        sim, score, action, name = 0.0, 0.0, "fork", forced
        if ts is not None and ts > self.now:  # the clock of the fold never runs back; NaN and null leave it
            self.now = ts
        if forced is not None:
            if name in self.branches:
                sim = self.branches[name].cosine(x)
                score, action = self.branches[name].strangeness(x, conflict, self.cfg), "attach"
        else:
            near = self.newest.best(self.candidates, self.active, self.now)
            if near:
                scores = strangeness_of([self.branches[b] for b in near], x, conflict, self.cfg)
                i = int(np.argmin(scores))
                score, name = float(scores[i]), near[i]
                sim = self.branches[name].cosine(x)
                action = "attach" if score < self.cfg.attach_below else "tension" if score < self.cfg.tension_below else "fork"
            if action == "fork":
                self.fresh += 1
                name = f"{self.prefix}{self.fresh}"
        # a branch keeps the type it began with
        mode = update_mode(action, self.types.setdefault(name, branch_type), sim, conflict, forced is not None, self.cfg)
        before = self.last.get(name)
        linked = before is not None and mode in ("refine", "contradict", "supersede")
        prev, root, version = (before[0], before[1], before[2] + 1) if linked else (None, item, 1)
        self.last[name] = (item, root, version)
        if name in self.branches:
            self.branches[name].add(x, self.cfg)
        else:
            self.branches[name] = Branch(x)
        self.turn, self.active = self.turn + 1, name
        gone = self.newest.put(name, self.branches[name], self.turn, self.now)
        if gone is not None and self.forget:
            del self.branches[gone], self.last[gone], self.types[gone]
        return item, name, action, score, sim, mode, prev, root if linked else None, version, self.branches[name].drift


def _folding(cfg: Config):
    """Batches in order of the items; the state is that of all branches."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = Fold(cfg, forget=True)
        for pdf in batches:
            rows = [fold.step(r.item, np.asarray(r.x, float), float(r.conflict), r.branch_type, None, r.ts) for r in pdf.itertuples()]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in FOLD_SCHEMA.split(", ")])
            yield out.astype({"prev_item": "Int64", "root_item": "Int64"})

    return f


#: Item numbers that one slice of a branch spans, so that a branch of any length is folded in parallel.
SLICE_ITEMS = 20_000


def _shrink(k: np.ndarray, rho: float) -> np.ndarray:
    """The product of (1 - rho / i) over i = 2 ... k; 1 for k below 2."""
    lg = np.vectorize(math.lgamma, otypes=[float])
    k = np.maximum(k, 1).astype(float)
    return np.exp(lg(k + 1 - rho) - math.lgamma(2 - rho) - lg(k + 1))


class Slice:
    """The items of one slice of a branch in order, and what of the running mean and the anchor does not need the slices before.

    The mean before item k is p(k-1) times the sum of c_j = w_j x_j / p_j over the items before, w_1 = 1 and w_j = rho / j;
    the mean that item k leads to is m_k = ((k-1) mean + x_k) / k, and the anchor moves towards m_k by a fixed share.
    """

    def __init__(self, pdf: pd.DataFrame, cfg: Config):
        self.pdf = pdf.sort_values("item", kind="stable")
        self.x = np.stack(self.pdf["x"].to_numpy()).astype(float)
        self.k = int(pdf["start"].iloc[0]) + 1 + np.arange(len(pdf))
        self.before = _shrink(self.k - 1, cfg.ema_rho)[:, None]
        weight = np.where(self.k == 1, 1.0, cfg.ema_rho / self.k) / _shrink(self.k, cfg.ema_rho)
        self.c = weight[:, None] * self.x
        self.sums = np.cumsum(self.c, axis=0) - self.c
        self.share = (self.k[:, None] - 1) / self.k[:, None]
        self.cfg = cfg

    def towards(self, carried: np.ndarray) -> np.ndarray:
        """m_k of every item, given the sum over the slices before."""
        return self.share * self.before * (carried + self.sums) + self.x / self.k[:, None]

    def anchors(self, m: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """The anchor before every item and after the last."""
        out = np.empty((len(m) + 1, m.shape[1]))
        out[0] = anchor
        stay = 1 - self.cfg.anchor_rho
        at = 0
        if self.k[0] == 1:
            out[1], at = self.x[0], 1
        for a in range(at, len(m), 256):
            part = m[a : a + 256]
            power = stay ** np.arange(1, len(part) + 1)[:, None]
            out[a + 1 : a + 1 + len(part)] = power * (out[a] + np.cumsum(self.cfg.anchor_rho * part / power, axis=0))
        return out


def _slice_sums(cfg: Config):
    """What a slice adds: its sum c, and the anchor after it as u + v * (sum before it) + a * (anchor before it)."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Slice(pdf, cfg)
        zero = np.zeros(s.x.shape[1])
        stay = 1 - cfg.anchor_rho
        u = s.anchors(s.towards(zero), zero)[-1]
        # the same of the part that goes with the sum before: one number, since it scales that sum
        lead = (s.share * s.before)[:, 0]
        power = stay ** (s.k[-1] - s.k)
        v = float((cfg.anchor_rho * lead * power)[s.k > 1].sum())
        a = 0.0 if s.k[0] == 1 else stay ** len(s.k)
        return pd.DataFrame({"forced_branch": [pdf["forced_branch"].iloc[0]], "slice": [int(pdf["slice"].iloc[0])], "c": [s.c.sum(axis=0)], "u": [u], "v": [v], "a": [float(a)]})

    return f


def _carry_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per slice of one branch: the sum over the slices before it, and the anchor before it. One row a slice."""
    pdf = pdf.sort_values("slice")
    carried, anchor, out = None, None, []
    for r in pdf.itertuples():
        c, u = np.asarray(r.c), np.asarray(r.u)
        carried = np.zeros_like(c) if carried is None else carried
        anchor = np.zeros_like(u) if anchor is None else anchor
        out.append((r.forced_branch, r.slice, carried, anchor))
        anchor = u + r.v * carried + r.a * anchor
        carried = carried + c
    return pd.DataFrame(out, columns=["forced_branch", "slice", "carried", "anchor"])


_MOVES = ("mu", "rank", "aniso", "trace")
_MOVED = "forced_branch string, slice long, item long, k long, sim double, conflict double, drift double, mode string, linked boolean, " + ", ".join(f"{m} double" for m in _MOVES)


def _slice_moves(cfg: Config):
    """Similarity, update mode, moves and drift of every item of a slice."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Slice(pdf, cfg)
        p, first = s.pdf, s.k == 1
        mean = s.before * (np.asarray(pdf["carried"].iloc[0]) + s.sums)
        m = s.towards(np.asarray(pdf["carried"].iloc[0]))
        length = lambda v: np.sqrt((v * v).sum(axis=1))
        sim = np.where(first, 0.0, (s.x * mean).sum(axis=1) / ((length(s.x) + EPS) * (length(mean) + EPS)))
        new = _spectra((s.x - m) ** 2 / s.k[:, None])
        old = Branch._spectrum(np.zeros(s.x.shape[1]))
        moves = np.stack([length(m - mean), *(np.abs(b - a) for a, b in zip(old, new))], axis=1)
        moves = np.where((moves > LEAST_MOVE) & ~first[:, None], moves, 0.0)
        anchors = s.anchors(m, np.asarray(pdf["anchor"].iloc[0]))
        drift = np.where(first, 0.0, length(anchors[1:] - anchors[:-1]))
        conflict = p["conflict"].to_numpy(float)
        mode = [update_mode("fork" if one else "attach", t, float(z), float(c), True, cfg) for one, t, z, c in zip(first, p["branch_type"], sim, conflict)]
        out = pd.DataFrame({"forced_branch": p["forced_branch"].to_numpy(), "slice": p["slice"].to_numpy(), "item": p["item"].to_numpy(), "k": s.k, "sim": sim, "conflict": conflict, "drift": drift, "mode": mode})
        out["linked"] = out["mode"].isin(["refine", "contradict", "supersede"])
        return out.assign(**{n: moves[:, i] for i, n in enumerate(_MOVES)})

    return f


def _usual(d: np.ndarray, begin: np.ndarray, rho: float) -> np.ndarray:
    """The slow mean of each kind of move before every item and after the last; the first positive move begins it."""
    out = np.empty((len(d) + 1, d.shape[1]))
    for i in range(d.shape[1]):
        e, col = begin[i], d[:, i]
        at = 0
        if e <= 0:
            positive = np.flatnonzero(col > 0)
            at = int(positive[0]) + 1 if len(positive) else len(col)
            out[:at, i] = 0.0
            e = col[at - 1] if len(positive) else 0.0
        out[at, i] = e
        for a in range(at, len(col), 256):
            part = col[a : a + 256]
            power = (1 - rho) ** np.arange(1, len(part) + 1)
            out[a + 1 : a + 1 + len(part), i] = power * (out[a, i] + np.cumsum(rho * part / power))
    return out


def _slice_ends(cfg: Config):
    """What a slice hands on: the slow means from none and as a share of those before, its last item and the last chain begun in it."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("k")
        d = p[list(_MOVES)].to_numpy(float)
        fresh = _usual(d, np.zeros(4), cfg.ema_rho)[-1]
        power = (1 - cfg.ema_rho) ** np.arange(len(d) - 1, -1, -1)[:, None]
        begun = p[~p["linked"]]
        row = (p["forced_branch"].iloc[0], int(p["slice"].iloc[0]), fresh, (cfg.ema_rho * power * d).sum(axis=0), float((1 - cfg.ema_rho) ** len(d)), int(p["item"].iloc[-1]), int(begun["item"].iloc[-1]) if len(begun) else None, int(begun["k"].iloc[-1]) if len(begun) else None)
        return pd.DataFrame([row], columns=["forced_branch", "slice", "fresh", "added", "share", "last", "root", "root_k"]).astype({"root": "Int64", "root_k": "Int64"})

    return f


def _carry_ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per slice of one branch: the slow means, the item and the chain before it."""
    usual, last, root, root_k, out = np.zeros(4), None, None, None, []
    for r in pdf.sort_values("slice").itertuples():
        out.append((r.forced_branch, r.slice, usual, last, root, root_k))
        usual = np.where(usual > 0, np.asarray(r.added) + r.share * usual, np.asarray(r.fresh))
        last = r.last
        if not pd.isna(r.root):
            root, root_k = int(r.root), int(r.root_k)
    return pd.DataFrame(out, columns=["forced_branch", "slice", "usual", "last", "root", "root_k"]).astype({c: "Int64" for c in ("last", "root", "root_k")})


def _slice_result(cfg: Config):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("k")
        d = p[list(_MOVES)].to_numpy(float)
        usual = _usual(d, np.asarray(p["usual"].iloc[0], float), cfg.ema_rho)[:-1]
        weights = np.array([cfg.gamma_mu, cfg.gamma_rank, cfg.gamma_anisotropy, cfg.gamma_trace])
        k, item, linked = p["k"].to_numpy(np.int64), p["item"].to_numpy(np.int64), p["linked"].to_numpy(bool)
        score = cfg.gamma_semantic * (1 - p["sim"].to_numpy()) + cfg.gamma_conflict * p["conflict"].to_numpy() + (d / (usual + EPS)) @ weights
        # place of the item that began the chain: the last one not linked, here or in a slice before
        at = np.maximum.accumulate(np.where(linked, -1, np.arange(len(k))))
        early = at < 0
        root = np.where(early, p["root"].fillna(-1).iloc[0], item[np.maximum(at, 0)])
        root_k = np.where(early, p["root_k"].fillna(-1).iloc[0], k[np.maximum(at, 0)])
        prev = np.concatenate([[p["last"].fillna(-1).iloc[0]], item[:-1]])
        first = k == 1
        keep = lambda v: pd.array(v.astype(np.int64), "Int64").copy()
        out = pd.DataFrame({"item": item, "branch_id": p["forced_branch"].to_numpy(), "action": np.where(first, "fork", "attach"), "score": np.where(first, 0.0, score), "sim": p["sim"].to_numpy(), "update_mode": p["mode"].to_numpy()})
        out["prev_item"], out["root_item"] = keep(prev), keep(root)
        out.loc[~linked, ["prev_item", "root_item"]] = pd.NA
        out["version"], out["anchor_drift"] = np.where(linked, k - root_k + 1, 1), p["drift"].to_numpy()
        return out

    return f


def _side_by_side(cfg: Config):
    """The fold of many short branches at once: step k takes the k-th item of every branch that has one."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        # the longest branches first, so that those still going on are the first ones
        n = pdf.groupby("forced_branch")["item"].transform("size")
        p = pdf.assign(_n=n).sort_values(["_n", "forced_branch", "item"], ascending=[False, True, True], kind="stable")
        k = p.groupby("forced_branch", sort=False).cumcount().to_numpy()
        order = np.argsort(k, kind="stable")
        p, k = p.iloc[order], k[order]
        x = np.stack(p["x"].to_numpy()).astype(float)
        conflict, item, types = p["conflict"].to_numpy(float), p["item"].to_numpy(np.int64), p["branch_type"].to_numpy()
        steps = np.append(np.searchsorted(k, np.arange(k[-1] + 1)), len(k))
        length = lambda v: np.sqrt((v * v).sum(axis=1))
        old = Branch._spectrum(np.zeros(x.shape[1]))
        weights = np.array([cfg.gamma_mu, cfg.gamma_rank, cfg.gamma_anisotropy, cfg.gamma_trace])
        width = steps[1]
        mean, anchor, usual = x[:width].copy(), x[:width].copy(), np.zeros((width, 4))
        last, root, version = item[:width].copy(), item[:width].copy(), np.ones(width, np.int64)
        score, sim, drift = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
        prev_of, root_of, version_of = np.full(len(x), -1), np.full(len(x), -1), np.ones(len(x), np.int64)
        mode = np.full(len(x), "fork", object)
        for s in range(1, len(steps) - 1):
            a, b = steps[s], steps[s + 1]
            m, now = b - a, x[a:b]
            was = mean[:m]
            z = (now * was).sum(axis=1) / ((length(now) + EPS) * (length(was) + EPS))
            moved = (s * was + now) / (s + 1)
            new = _spectra((now - moved) ** 2 / (s + 1))
            d = np.stack([length(moved - was), *(np.abs(v - o) for v, o in zip(new, old))], axis=1)
            d = np.where(d > LEAST_MOVE, d, 0.0)
            score[a:b] = cfg.gamma_semantic * (1 - z) + cfg.gamma_conflict * conflict[a:b] + (d / (usual[:m] + EPS)) @ weights
            usual[:m] = np.where(usual[:m] <= 0, d, (1 - cfg.ema_rho) * usual[:m] + cfg.ema_rho * d)
            mean[:m] = (1 - cfg.ema_rho) * was + cfg.ema_rho * moved
            step = cfg.anchor_rho * (moved - anchor[:m])
            anchor[:m] += step
            sim[a:b], drift[a:b] = z, length(step)
            names = [update_mode("attach", t, float(u), float(c), True, cfg) for t, u, c in zip(types[a:b], z, conflict[a:b])]
            mode[a:b] = names
            linked = np.isin(names, ["refine", "contradict", "supersede"])
            prev_of[a:b], root_of[a:b] = np.where(linked, last[:m], -1), np.where(linked, root[:m], -1)
            version[:m] = np.where(linked, version[:m] + 1, 1)
            root[:m] = np.where(linked, root[:m], item[a:b])
            last[:m], version_of[a:b] = item[a:b], version[:m]
        out = pd.DataFrame({"item": item, "branch_id": p["forced_branch"].to_numpy(), "action": np.where(k == 0, "fork", "attach"), "score": score, "sim": sim, "update_mode": mode})
        for name, v in (("prev_item", prev_of), ("root_item", root_of)):
            out[name] = pd.array(v, "Int64")
            out.loc[v < 0, name] = pd.NA
        out["version"], out["anchor_drift"] = version_of, drift
        return out

    return f


#: A branch with more items than this is cut into slices; shorter ones are folded side by side, about so many items in a task.
SHORT, TOGETHER = 2000, 50_000


def forced_fold(items: DataFrame, cfg: Config = Config(), slice_items: int = SLICE_ITEMS, short: int = SHORT) -> DataFrame:
    """Items of given branches (item, forced_branch, x, conflict, branch_type), each branch in order of its items.

    What ``Fold`` does item by item is here in closed form: running mean and anchor are linear in the items, the slow means
    of the moves in the moves, and a chain goes back to the last item that began one. A long branch is cut into slices of item
    numbers; each slice is worked out on its own, and a row for each slice hands on what the next one needs. Short branches,
    which would be as many small slices, go through the same steps side by side.
    """
    scratch = Scratch(items.sparkSession, "forced")
    items = items.where("forced_branch IS NOT NULL")
    sizes = scratch.save(items.groupBy("forced_branch").agg(F.count(F.lit(1)).alias("n")), "sizes")
    long = sizes.where(F.col("n") > short).select("forced_branch")  # at most one for every ``short`` rows
    few = items.join(long, "forced_branch", "left_anti")
    light = sizes.where(F.col("n") <= short).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-light // TOGETHER))
    bucket = F.pmod(F.xxhash64("forced_branch"), F.lit(buckets))
    few = few.select("forced_branch", "item", "x", "conflict", "branch_type", bucket.alias("bucket"))
    out = few.repartition(parallelism(items.sparkSession, buckets, 1), "bucket").groupBy("bucket").applyInPandas(_side_by_side(cfg), FOLD_SCHEMA)
    if long.isEmpty():
        return out
    return out.unionByName(_sliced_fold(items.join(long, "forced_branch", "left_semi"), cfg, slice_items, scratch))


def _sliced_fold(items: DataFrame, cfg: Config, slice_items: int, scratch: Scratch) -> DataFrame:
    """The fold of long branches, slice by slice."""
    by = ["forced_branch", "slice"]
    rows = items.withColumn("slice", F.expr(f"item div {slice_items}"))
    rows = scratch.save(rows.select(*by, "item", "x", "conflict", "branch_type"), "rows")
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("forced_branch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = rows.join(starts, by)
    arrays = "array<double>"
    sums = placed.groupBy(*by).applyInPandas(_slice_sums(cfg), f"forced_branch string, slice long, c {arrays}, u {arrays}, v double, a double")
    carried = scratch.save(sums.groupBy("forced_branch").applyInPandas(_carry_sums, f"forced_branch string, slice long, carried {arrays}, anchor {arrays}"), "carried")
    moves = scratch.save(placed.join(carried, by).groupBy(*by).applyInPandas(_slice_moves(cfg), _MOVED), "moves")
    ends = moves.groupBy(*by).applyInPandas(_slice_ends(cfg), f"forced_branch string, slice long, fresh {arrays}, added {arrays}, share double, last long, root long, root_k long")
    handed = scratch.save(ends.groupBy("forced_branch").applyInPandas(_carry_ends, f"forced_branch string, slice long, usual {arrays}, last long, root long, root_k long"), "handed")
    return moves.join(handed, by).groupBy(*by).applyInPandas(_slice_result(cfg), FOLD_SCHEMA)


def free_fold(items: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Items without branch (item, x, conflict, branch_type, ts) allocated one after the other: serial, in one task,
    streamed in batches; the state is that of the newest 128 branches."""
    return items.repartition(1).sortWithinPartitions("item").mapInPandas(_folding(cfg), FOLD_SCHEMA)


def two_means(x: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Labels 0 / 1: centres begin at the first vector and the one farthest from it."""
    far = int(np.argmax(((x - x[0]) ** 2).sum(axis=1)))
    centres, labels = np.stack([x[0], x[far]]), np.zeros(len(x), int)
    for _ in range(max(4, rounds)):
        new = np.argmin(((x[:, None] - centres[None]) ** 2).sum(axis=2), axis=1)
        for c in (0, 1):
            if not (new == c).any():
                new[int(np.argmax(((x - centres[1 - c]) ** 2).sum(axis=1)))] = c
        if (new == labels).all():
            break
        labels = new
        centres = np.stack([x[labels == c].mean(axis=0) for c in (0, 1)])
    return labels


def _lloyd_sums(centres: dict[str, tuple], before: dict[str, tuple], dim: int):
    """Per task and branch of ``centres``: for each label its rows, their sum, and the row farthest from its centre;
    and how many rows changed their label since ``before``."""

    def near(x: np.ndarray, seq: np.ndarray, state: tuple) -> np.ndarray:
        c, moved = state
        if c is None:
            return np.zeros(len(x), int)
        labels = np.argmin(np.stack([((x - v) ** 2).sum(axis=1) for v in c], axis=1), axis=1)
        if moved is not None:
            labels[seq == moved[1]] = moved[0]
        return labels

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[str, list] = {}
        for batch in batches:
            names = batch.column("branch_id").to_numpy(zero_copy_only=False)
            seqs = batch.column("ingest_seq").to_numpy(zero_copy_only=False)
            xs = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
            for name in set(names.tolist()) & set(centres):
                x, seq = xs[names == name], seqs[names == name]
                labels = near(x, seq, centres[name])
                t = acc.setdefault(name, [[0, 0], [np.zeros(dim), np.zeros(dim)], [(-1.0, 0, None)] * 2, 0])
                t[3] += int((labels != near(x, seq, before[name])).sum())
                for c in (0, 1):
                    d = ((x - centres[name][0][c]) ** 2).sum(axis=1)
                    i = np.lexsort((seq, -d))[0]  # of equally far ones the first
                    t[0][c] += int((labels == c).sum())
                    t[1][c] += x[labels == c].sum(axis=0)
                    t[2][c] = max(t[2][c], (float(d[i]), -int(seq[i]), x[i].tolist()), key=lambda r: r[:2])
        rows = [(b, c, n[c], s[c].tolist(), far[c][0], -far[c][1], far[c][2], changed) for b, (n, s, far, changed) in acc.items() for c in (0, 1)]
        cols = list(zip(*rows)) or [[]] * len(_SUMS)
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(cols, _SUMS.values())], names=list(_SUMS))

    return f


_SUMS = {"branch_id": pa.string(), "label": pa.int32(), "n": pa.int64(), "total": pa.list_(pa.float64()), "far": pa.float64(), "far_seq": pa.int64(), "far_x": pa.list_(pa.float64()), "changed": pa.int64()}
_SUMS_SCHEMA = "branch_id string, label int, n long, total array<double>, far double, far_seq long, far_x array<double>, changed long"


def _long_centres(rows: DataFrame, dim: int, rounds: int = 20) -> list[tuple[str, list[float], list[float]]]:
    """(branch_id, c0, c1) by the rounds of ``two_means`` over all rows, as sums per task; the driver holds only
    the centres of the branches in ``rows`` (few: each is longer than what fits into one task)."""

    def pass_over(centres: dict, before: dict) -> dict[str, list]:
        out: dict[str, list] = {}
        for r in rows.mapInArrow(_lloyd_sums(centres, before, dim), _SUMS_SCHEMA).collect():
            t = out.setdefault(r["branch_id"], [[0, 0], np.zeros((2, dim)), [(-1.0, 0, None)] * 2, 0])
            c = r["label"]
            t[0][c] += r["n"]
            t[1][c] += r["total"]
            t[2][c] = max(t[2][c], (r["far"], -r["far_seq"], r["far_x"]), key=lambda v: v[:2])
            t[3] += r["changed"] if c == 0 else 0
        return out

    none = (None, None)
    first = {r["branch_id"]: np.array(r["f"]["x"], float) for r in rows.groupBy("branch_id").agg(F.min(F.struct("ingest_seq", F.col("embedding").alias("x"))).alias("f")).collect()}
    state = {b: (np.stack([x, x]), None) for b, x in first.items()}
    if not state:
        return []
    seen = pass_over(state, dict.fromkeys(state, none))
    centres = {b: np.stack([first[b], seen[b][2][0][2]]) for b in state}
    before: dict[str, tuple] = dict.fromkeys(state, none)
    busy = set(state)
    for _ in range(max(4, rounds)):
        seen = pass_over({b: (centres[b], None) for b in busy}, {b: before[b] for b in busy})
        for b, (n, total, far, changed) in seen.items():
            moved = None
            for c in (0, 1):
                if not n[c]:  # an empty cluster takes the row farthest from the other centre
                    _, seq, x = far[1 - c]
                    moved = (c, -seq)
                    # all rows had the other label; in the first round the labels before are all 0
                    was = before[b]
                    same = was[1] == moved and was[0] is not None and np.array_equal(was[0], centres[b])
                    changed = 0 if same else 1
                    n[c], n[1 - c] = 1, n[1 - c] - 1
                    total[c], total[1 - c] = x, total[1 - c] - np.array(x)
            if not changed:
                busy.discard(b)
                continue
            before[b] = (centres[b], moved)
            centres[b] = total / np.array(n, float)[:, None]
        if not busy:
            break
    return [(b, c[0].tolist(), c[1].tolist()) for b, c in centres.items()]


def split_branches(nodes: DataFrame, dim: int, least: int = 8, most: int = 200_000) -> DataFrame:
    """(branch_id, ingest_seq, child) of branches to split: two children each by 2-means over all their vectors.

    The vectors of one branch fit into one task up to ``most`` of them; for longer branches every round
    is a distributed sum per (branch, label), so no vector is left out at any size.
    """
    rows = nodes.where(V.usable(F.col("embedding"), dim)).select("branch_id", "ingest_seq", "embedding")
    size = rows.groupBy("branch_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rows = rows.join(size, "branch_id")

    def centres(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ingest_seq")
        x = np.stack(g["embedding"].to_numpy()).astype(float)
        labels = two_means(x)
        c = [x[labels == i].mean(axis=0).tolist() if (labels == i).any() else x[0].tolist() for i in (0, 1)]
        return pd.DataFrame({"branch_id": [g["branch_id"].iloc[0]], "c0": [c[0]], "c1": [c[1]]})

    schema = "branch_id string, c0 array<double>, c1 array<double>"
    found = rows.where(F.col("n") <= most).select("branch_id", "ingest_seq", "embedding").groupBy("branch_id").applyInPandas(centres, schema)
    long = rows.where(F.col("n") > most).select("branch_id", "ingest_seq", "embedding")
    long = Scratch(nodes.sparkSession, "split").save(long.repartition(parallelism(nodes.sparkSession)), "long")
    found = found.unionByName(nodes.sparkSession.createDataFrame(_long_centres(long, dim), schema))
    # a child of a single vector is none: such a branch stays whole
    far = lambda c: F.aggregate(F.zip_with(V.doubles("embedding"), F.col(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    out = rows.join(found, "branch_id").select("branch_id", "ingest_seq", F.when(far("c1") < far("c0"), 1).otherwise(0).alias("child"))
    both = out.groupBy("branch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("child").alias("m")).where("m >= 2 AND n - m >= 2").select("branch_id")
    return out.join(both, "branch_id", "left_semi")


def children(split: DataFrame, first: int) -> DataFrame:
    """``split`` with the id of each child: numbers from ``first`` on, in the order of the branches and children (a short list)."""
    names = split.select("branch_id", "child").distinct()
    order = F.row_number().over(Window.orderBy("branch_id", "child"))
    named = names.withColumn("child_id", F.concat(F.lit("conv_"), (order + F.lit(first - 1)).cast("string")))
    return split.join(named, ["branch_id", "child"])


def merge_edges(pairs: DataFrame) -> DataFrame:
    """(src_id, dst_id, edge_type, weight): an edge of topic each way for every pair (branch_a, branch_b, merge_score)."""
    weight = V.clamp(F.col("merge_score"), 0.05, 3.0).alias("weight")
    ends = F.explode(F.array(*[F.struct(F.col(a).alias("src_id"), F.col(b).alias("dst_id")) for a, b in (("branch_a", "branch_b"), ("branch_b", "branch_a"))])).alias("e")
    return pairs.select(ends, weight).select("e.src_id", "e.dst_id", F.lit("same_topic").alias("edge_type"), "weight")

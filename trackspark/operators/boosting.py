"""Gradient-boosted trees for several categories at once (softmax), grown by shared histograms.

Features are cut into bins and rows packed into blocks, which are kept. A model grows a tree a category and round, level
by level: a pass over the blocks adds up gradients and Hessians by (node, feature, bin) in each task, the sums of all
tasks meet by model and category, where the best split of each node is found, and only the splits come to the driver.
All models that are trained together, such as the folds and candidates of a search or pairs of categories, share each
pass, so they cost the passes of the one with the most rounds and levels. Margins are brought up to date every few
rounds from the trees alone, so a lost block is made again from its rows, not from earlier rounds.

What tasks and driver hold depends on features, bins, categories and nodes, not on rows: models are trained in waves
whose histograms have at most ``cells`` entries (one model may have more).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    n_estimators: int = 100
    learning_rate: float = 0.3
    max_depth: int = 6
    gamma: float = 0.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    min_child_weight: float = 1.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0


@dataclass(frozen=True)
class Engine:
    bins: int = 32
    block_rows: int = 16384
    refresh: int = 16
    cells: int = 1 << 22
    accuracy: int = 10_000


@dataclass(frozen=True)
class Job:
    """A model to train on the rows of ``labels`` (ascending) whose place in their category is below its limit.

    It is scored on the others; if ``held`` is given, it is trained without those whose place modulo ``k`` is that, and
    scored on them.
    """

    labels: tuple[int, ...]
    params: Params
    limits: tuple[int, ...]
    k: int = 0
    held: int | None = None
    seed: int = 42


@dataclass
class Tree:
    """Nodes numbered from the root, those under i being 2 i + 1 and 2 i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    sums: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.zeros((n, 2)))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf, so far, of each row."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at


@dataclass
class Model:
    job: Job
    rounds: list[list[Tree]] = field(default_factory=list)

    def gains(self, features: int) -> np.ndarray:
        """Mean gain of each feature's splits, as shares of one."""
        total, n = np.zeros(features), np.zeros(features)
        for tree in (t for trees in self.rounds for t in trees):
            used = tree.feature >= 0
            np.add.at(total, tree.feature[used], tree.gain[used])
            np.add.at(n, tree.feature[used], 1)
        mean = np.divide(total, n, out=np.zeros(features), where=n > 0)
        return mean / mean.sum() if mean.sum() > 0 else mean


def margins(rounds: list[list[Tree]], bins: np.ndarray, classes: int) -> np.ndarray:
    out = np.zeros((len(bins), classes))
    for trees in rounds:
        for c, tree in enumerate(trees):
            out[:, c] += tree.value[tree.nodes(bins)]
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """A value in [0, 1) for each 64-bit key, by the finalizer of SplitMix64."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def columns_of(job: Job, round_: int, c: int, features: int) -> np.ndarray:
    """The features that a tree may use."""
    n = max(1, round(job.params.colsample_bytree * features))
    return np.sort(np.random.default_rng([job.seed, round_, c]).choice(features, n, replace=False)) if n < features else np.arange(features)


def _parts(job: Job, labels: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows below their category's limit, and the others."""
    at = np.minimum(np.searchsorted(job.labels, labels), len(job.labels) - 1)
    mine = np.array(job.labels)[at] == labels
    below = place < np.array(job.limits)[at]
    return mine & below, mine & ~below


def trained_rows(job: Job, labels: np.ndarray, place: np.ndarray) -> np.ndarray:
    below, _ = _parts(job, labels, place)
    return below & (place % job.k != job.held) if job.held is not None else below


def scored_rows(job: Job, labels: np.ndarray, place: np.ndarray) -> np.ndarray:
    below, above = _parts(job, labels, place)
    return below & (place % job.k == job.held) if job.held is not None else above


def cuts(rows: DataFrame, features: int, how: Engine) -> list[np.ndarray]:
    """The values that a feature is cut at, evenly over its rows; a value goes right of those that it reaches."""
    probabilities = F.array(*(F.lit(float(x)) for x in np.linspace(0, 1, how.bins + 1)[1:-1]))
    each = rows.select(F.posexplode("features").alias("at", "value")).groupBy("at").agg(F.percentile_approx("value", probabilities, how.accuracy).alias("cuts"))
    found = {r["at"]: r["cuts"] for r in each.collect()}
    return [np.unique(np.array(found.get(i, []), float)) for i in range(features)]


BLOCK = "n long, keys binary, labels binary, place binary, bins binary"


def blocks(rows: DataFrame, edges: list[np.ndarray], how: Engine) -> DataFrame:
    """Packed rows of (object_id, label, place, features), in no more parts than run at once: each part of a pass sends histograms, whose size is not that of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, how.block_rows):
                part = batch.slice(at, how.block_rows)
                x = part.column("features").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                bins = np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)], axis=1).astype(np.uint16)
                values = [part.column(c).cast(t).to_numpy(zero_copy_only=False) for c, t in (("key", pa.int64()), ("label", pa.int32()), ("place", pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (*values, bins))], [c.split()[0] for c in BLOCK.split(", ")])

    packed = rows.select(F.xxhash64("object_id").alias("key"), "label", "place", "features")
    return packed.mapInArrow(run, BLOCK).coalesce(rows.sparkSession.sparkContext.defaultParallelism)


def opened(row: dict, features: int) -> tuple[np.ndarray, ...]:
    kinds = {"keys": np.int64, "labels": np.int32, "place": np.int64, "bins": np.uint16}
    keys, labels, place, bins = (np.frombuffer(row[c], t) for c, t in kinds.items())
    return keys, labels, place, bins.reshape(-1, features)


def derived(job: Job, margin: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the softmax loss."""
    p = softmax(margin)
    own = labels[:, None] == np.array(job.labels)[None, :]
    return p - own, np.maximum(2 * p * (1 - p), 1e-16)


def shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def score(g: np.ndarray, h: np.ndarray, p: Params) -> np.ndarray:
    return shrunk(g, p.reg_alpha) ** 2 / np.maximum(h + p.reg_lambda, 1e-16)


def best_split(g: np.ndarray, h: np.ndarray, usable: np.ndarray, p: Params) -> tuple[int, int, float, float, float]:
    """Feature, last bin on the left, gain, and the left side's sums, of histograms (feature, bin); feature -1: none."""
    left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    whole_g, whole_h = g[0].sum(), h[0].sum()
    gain = score(left_g, left_h, p) + score(whole_g - left_g, whole_h - left_h, p) - score(whole_g, whole_h, p)
    allowed = (left_h >= p.min_child_weight) & (whole_h - left_h >= p.min_child_weight)
    allowed[np.setdiff1d(np.arange(len(g)), usable)] = False
    gain = np.where(allowed, gain, -1.0)
    f, b = np.unravel_index(int(np.argmax(np.round(gain, 9))), gain.shape)
    if gain[f, b] <= 1e-6:
        return -1, 0, 0.0, 0.0, 0.0
    return int(f), int(b), float(gain[f, b]), float(left_g[f, b]), float(left_h[f, b])


def pruned(tree: Tree, p: Params) -> None:
    """Splits of less than gamma over two leaves are undone from below; then leaves get their values."""
    for i in reversed(range(len(tree.feature) // 2)):
        if tree.feature[i] >= 0 and tree.feature[2 * i + 1] < 0 and tree.feature[2 * i + 2] < 0 and tree.gain[i] < p.gamma:
            tree.feature[i] = -1
            tree.gain[i] = 0
    g, h = tree.sums.T
    tree.value = -p.learning_rate * shrunk(g, p.reg_alpha) / np.maximum(h + p.reg_lambda, 1e-16)


SUMS = "job long, class long, node long, g binary, h binary"
SPLITS = "job long, class long, node long, feature long, bin long, gain double, left_g double, left_h double, g double, h double"


def _level(kept: DataFrame, models: list[Model], growing: dict, round_: int, base: int, features: int, how: Engine) -> DataFrame:
    """Splits of the open nodes of each growing tree: (job, class) -> (tree, open nodes). ``kept`` has margins of the first ``base`` rounds."""
    spark = kept.sparkSession
    width = how.bins
    sent = spark.sparkContext.broadcast({j: (models[j].job, models[j].rounds[base:], {c: growing[j, c] for c in range(len(models[j].job.labels)) if (j, c) in growing}) for j in {j for j, _ in growing}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                keys, labels, place, bins = opened(row, features)
                known = {j: m for j, m in zip(row["jobs"], row["margins"])}
                for j, (job, rounds, trees) in sent.value.items():
                    mine = np.flatnonzero(trained_rows(job, labels, place))
                    own = bins[mine]
                    classes = len(job.labels)
                    start = np.frombuffer(known[j], np.float64).reshape(-1, classes)[mine] if j in known else 0
                    g, h = derived(job, start + margins(rounds, own, classes), labels[mine])
                    if job.params.subsample < 1:
                        drawn = uniform(keys[mine], job.seed + 1000003 * round_) < job.params.subsample
                        own, g, h = own[drawn], g[drawn], h[drawn]
                    flat = own.astype(np.int64) + np.arange(features) * width
                    for c, (tree, open_) in trees.items():
                        at = tree.nodes(own)
                        for node in open_:
                            here = np.flatnonzero(at == node)
                            cells = flat[here].ravel()
                            sums = np.stack([np.bincount(cells, np.repeat(v[here, c], features), features * width) for v in (g, h)])
                            key = j, c, node
                            total[key] = total[key] + sums if key in total else sums
        rows = [(*k, v[0].tobytes(), v[1].tobytes()) for k, v in total.items()]
        for i in range(0, len(rows), 64):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), kinds)], [x.split()[0] for x in SUMS.split(", ")])

    def found(table: pa.Table) -> pa.Table:
        j, c = table.column("job")[0].as_py(), table.column("class")[0].as_py()
        job = sent.value[j][0]
        usable = columns_of(job, round_, c, features)
        total: dict[int, np.ndarray] = {}
        for node, *parts in sorted(zip(*(table.column(x).to_pylist() for x in ("node", "g", "h")))):
            sums = np.stack([np.frombuffer(x, np.float64) for x in parts])
            total[node] = total[node] + sums if node in total else sums
        out = []
        for node, sums in total.items():
            g, h = sums.reshape(2, features, width)
            out.append((j, c, node, *best_split(g, h, usable, job.params), float(g[0].sum()), float(h[0].sum())))
        names = [x.split()[0] for x in SPLITS.split(", ")]
        return pa.table([pa.array(v, pa.int64() if i < 5 else pa.float64()) for i, v in enumerate(zip(*out))], names=names)

    return kept.mapInArrow(run, SUMS).groupBy("job", "class").applyInArrow(found, SPLITS)


def _kept(packed: DataFrame, models: list[Model], active: list[int], features: int) -> DataFrame:
    """The blocks with the margins of the active models, from all their trees so far; nothing else is carried over."""
    if not any(models[j].rounds for j in active):
        return packed.withColumns({"jobs": F.array().cast("array<long>"), "margins": F.array().cast("array<binary>")})
    sent = packed.sparkSession.sparkContext.broadcast({j: (len(models[j].job.labels), models[j].rounds) for j in active})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                bins = opened(row, features)[-1]
                found.append([margins(rounds, bins, classes).tobytes() for classes, rounds in sent.value.values()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([list(sent.value)] * len(found), pa.list_(pa.int64())), pa.array(found, pa.list_(pa.binary()))], [*batch.schema.names, "jobs", "margins"])

    return packed.mapInArrow(run, f"{BLOCK}, jobs array<long>, margins array<binary>").persist()


def _wave(packed: DataFrame, models: list[Model], features: int, how: Engine) -> None:
    """Trains the models side by side."""
    kept, base = _kept(packed, models, list(range(len(models))), features), 0
    for round_ in range(max(m.job.params.n_estimators for m in models)):
        active = [j for j, m in enumerate(models) if round_ < m.job.params.n_estimators]
        if round_ - base >= how.refresh:
            if base:
                kept.unpersist()
            kept, base = _kept(packed, models, active, features), round_
        trees = {(j, c): Tree.empty(models[j].job.params.max_depth) for j in active for c in range(len(models[j].job.labels))}
        growing = {key: (tree, [0]) for key, tree in trees.items() if models[key[0]].job.params.max_depth > 0}
        for level in range(max(models[j].job.params.max_depth for j in active)):
            coming: dict = {}
            for r in _level(kept, models, growing, round_, base, features, how).collect() if growing else ():
                tree, p, i = trees[r["job"], r["class"]], models[r["job"]].job.params, r["node"]
                tree.sums[i] = r["g"], r["h"]
                if r["feature"] >= 0:
                    tree.feature[i], tree.cut[i], tree.gain[i] = r["feature"], r["bin"], r["gain"]
                    tree.sums[2 * i + 1] = r["left_g"], r["left_h"]
                    tree.sums[2 * i + 2] = r["g"] - r["left_g"], r["h"] - r["left_h"]
                    if level + 1 < p.max_depth:
                        coming.setdefault((r["job"], r["class"]), (tree, []))[1].extend((2 * i + 1, 2 * i + 2))
            growing = coming
        for j in active:
            models[j].rounds.append([trees[j, c] for c in range(len(models[j].job.labels))])
            for tree in models[j].rounds[-1]:
                pruned(tree, models[j].job.params)
    if base:
        kept.unpersist()


def train(packed: DataFrame, jobs: Sequence[Job], features: int, how: Engine = Engine()) -> list[Model]:
    """A model for each job, trained in waves over the packed rows."""
    models = [Model(j) for j in jobs]
    size = lambda m: len(m.job.labels) * 2 ** max(m.job.params.max_depth - 1, 0) * features * how.bins
    wave: list[Model] = []
    for m in sorted(models, key=lambda m: (m.job.params.n_estimators, m.job.params.max_depth)):
        if wave and sum(map(size, wave)) + size(m) > how.cells:
            _wave(packed, wave, features, how)
            wave = []
        wave.append(m)
    if wave:
        _wave(packed, wave, features, how)
    return models


def predictions(packed: DataFrame, models: list[Model], features: int) -> DataFrame:
    """job, label, predicted label and the number of rows, over the rows that each model is scored on."""
    sent = packed.sparkSession.sparkContext.broadcast([(m.job, m.rounds) for m in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                _, labels, place, bins = opened(row, features)
                for j, (job, rounds) in enumerate(sent.value):
                    mine = scored_rows(job, labels, place)
                    said = np.array(job.labels)[margins(rounds, bins[mine], len(job.labels)).argmax(axis=1)]
                    pairs, n = np.unique(np.stack([labels[mine], said], axis=1), axis=0, return_counts=True)
                    rows += [(j, int(a), int(b), int(k)) for (a, b), k in zip(pairs, n)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["job", "label", "said", "n"])

    return packed.mapInArrow(run, "job long, label long, said long, n long").groupBy("job", "label", "said").agg(F.sum("n").alias("n"))

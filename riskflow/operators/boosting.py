"""Newton boosting for any loss that gives a gradient and a hessian, by histograms of coded features (MDL-14, MDL-1)."""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions.losses import focal_arrays, focal_cross_entropy, focal_terms
from riskflow.functions.scalars import quoted, sigmoid
from riskflow.operators import metrics
from riskflow.operators.models import _BoostedTrees
from riskflow.session import discard, materialise, scratch_path

Terms = Callable[[Column, Column], tuple[Column, Column]]
Loss = Callable[[Column, Column], Column]

#: Least hessian of a row: what a tree tells apart is the quotient of gradient and hessian.
LEAST_HESSIAN = 1e-9
#: Gains that differ by no more than this share are equal, so that trees don't hang on the order of sums.
SAME_GAIN = 1e-12


class Tree:
    """Splits in heap order: node ``i`` sends the codes in ``left`` of its feature to ``2 i + 1``, all others to ``2 i + 2``."""

    def __init__(self, splits: dict[int, tuple[int, list[int]]], steps: dict[int, float]) -> None:
        self.splits, self.steps = splits, steps

    def places(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row of ``codes`` (features by rows) ends in."""
        at = np.zeros(codes.shape[1], np.int32)
        waiting = [(0, np.arange(codes.shape[1]))]
        while waiting:
            node, rows = waiting.pop()
            if node not in self.splits:
                at[rows] = node
                continue
            j, some = self.splits[node]
            left = np.zeros(max(max(some) + 1, int(codes[j].max(initial=0)) + 1), bool)
            left[some] = True
            goes = left[codes[j][rows]]
            waiting += [(2 * node + 1, rows[goes]), (2 * node + 2, rows[~goes])]
        return at

    def values(self, codes: np.ndarray) -> np.ndarray:
        steps = np.zeros(max(self.steps) + 1)
        steps[list(self.steps)] = list(self.steps.values())
        return steps[self.places(codes)]


def _matrix(column: pa.Array) -> np.ndarray:
    """Features by rows of a column of equally long arrays."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1).T)


def _stepped(trees: Sequence[Tree], step: float) -> Callable[[Column], Column]:
    """The sum of the trees' steps for a column of codes."""

    @F.arrow_udf("double")
    def margin(codes: pa.Array) -> pa.Array:
        found = np.zeros(len(codes))
        if trees and len(codes):
            matrix = _matrix(codes)
            for tree in trees:
                found += step * tree.values(matrix)
        return pa.array(found)

    return margin


#: Rows to a block: a row of the table that training reads, whose columns are arrays as bytes.
BLOCK_ROWS = 1 << 16
_ROW = "codes array<int>, label double, weight double, held boolean, margin double"
_BLOCK = (
    "codes binary, label binary, weight binary, held binary, margin binary, gradient binary, hessian binary, "
    "train_loss double, train_weight double, held_loss double, held_weight double"
)


def _block(codes: np.ndarray, label: np.ndarray, weight: np.ndarray, held: np.ndarray, margin: np.ndarray, terms: Sequence[np.ndarray]) -> pa.RecordBatch:
    """One block; gradient and hessian are weighted and 0 for held rows, a missing loss is left out of the sums."""
    gradient, hessian, loss = terms
    known = ~np.isnan(loss)
    sums = []
    for side in (~held & known, held & known):
        sums += [float((loss[side] * weight[side]).sum()), float(weight[side].sum())]
    gradient = np.where(held, 0.0, weight * gradient)
    hessian = np.where(held, 0.0, weight * np.maximum(hessian, LEAST_HESSIAN))
    arrays = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (codes, label, weight, held, margin, gradient, hessian)]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array([x]) for x in sums)], names=[f.split()[0] for f in _BLOCK.split(", ")])


def _opened(batch: pa.RecordBatch, kind: np.dtype) -> Iterator[tuple[np.ndarray, ...]]:
    """Codes (features by rows), label, weight, held and margin of each block."""
    for codes, label, weight, held, margin in zip(*(batch.column(i) for i in range(5)), strict=True):
        label, weight, margin = (np.frombuffer(x.as_buffer(), np.float64) for x in (label, weight, margin))
        yield np.frombuffer(codes.as_buffer(), kind).reshape(-1, len(label)), label, weight, np.frombuffer(held.as_buffer(), bool), margin


def _packed(rows: DataFrame, terms: Terms, loss: Loss, kind: np.dtype) -> DataFrame:
    """Blocks of ``rows``, with the terms and the loss at their margins."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            if batch.num_rows:
                parts.append((_matrix(batch.column(0)).astype(kind), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])))
            if parts and sum(len(p[1]) for p in parts) >= BLOCK_ROWS:
                yield join(parts)
                parts = []
        if parts:
            yield join(parts)

    def join(parts: list[tuple]) -> pa.RecordBatch:
        codes, label, weight, held, margin, *found = (np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))
        return _block(codes, label, weight, held.astype(bool), margin, found)

    gradient, hessian = terms(F.col("label"), F.col("margin"))
    found = [gradient, hessian, loss(F.col("label"), sigmoid("margin"))]
    columns = [F.col(f.split()[0]) for f in _ROW.split(", ")]
    return rows.select(*columns, *(c.cast("double").alias(f"_term_{i}") for i, c in enumerate(found))).mapInArrow(pack, _BLOCK)


def _moved(blocks: DataFrame, tree: Tree, step: float, terms: Terms, loss: Loss, kind: np.dtype) -> DataFrame:
    """``blocks`` with their margins moved by a tree. The focal loss is computed where the blocks are; one of the caller's own is
    made of columns, so its blocks are taken apart for it."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, label, weight, held, margin in _opened(batch, kind):
                margin = margin + step * tree.values(codes)
                yield _block(codes, label, weight, held, margin, focal_arrays(label, margin))

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, label, weight, held, margin in _opened(batch, kind):
                margin = margin + step * tree.values(codes)
                ends = pa.array(np.arange(len(label) + 1, dtype=np.int32) * len(codes))
                each = pa.ListArray.from_arrays(ends, pa.array(codes.T.astype(np.int32).ravel()))
                arrays = [each, pa.array(label, from_pandas=True), *map(pa.array, (weight, held, margin))]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _ROW.split(", ")])

    if terms is focal_terms and loss is focal_cross_entropy:
        return blocks.mapInArrow(move, _BLOCK)
    return _packed(blocks.mapInArrow(take_apart, _ROW), terms, loss, kind)


def _histograms(blocks: DataFrame, tree: Tree, nodes: Sequence[int], widths: Sequence[int], kind: np.dtype) -> list[np.ndarray]:
    """For each feature the sums of gradient and hessian by node and code; tasks add up their rows, Spark their sums."""
    ends = np.cumsum([len(nodes) * w for w in widths])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.full(2 * max(nodes) + 3, -1)
        slots[list(nodes)] = np.arange(len(nodes))
        sums = np.zeros((2, ends[-1]))
        for batch in batches:
            for block in zip(*batch.columns, strict=True):
                terms = [np.frombuffer(x.as_buffer(), np.float64) for x in block[1:]]
                codes = np.frombuffer(block[0].as_buffer(), kind).reshape(-1, len(terms[0]))
                slot = slots[tree.places(codes)]
                live = np.flatnonzero((slot >= 0) & (terms[1] != 0))  # not held
                if len(live) < len(slot):
                    codes, slot, terms = codes[:, live], slot[live], [t[live] for t in terms]
                for j, width in enumerate(widths):
                    size = len(nodes) * width
                    cell = slot * width + codes[j]
                    for k, term in enumerate(terms):
                        sums[k, ends[j] - size : ends[j]] += np.bincount(cell, term, size)
        cells = np.flatnonzero(sums[1] != 0)  # NaN is kept
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sums[0, cells]), pa.array(sums[1, cells])], names=["cell", "gradient", "hessian"])

    tasks = blocks.select("codes", "gradient", "hessian").mapInArrow(add, "cell bigint, gradient double, hessian double")
    found = tasks.groupBy("cell").agg(F.sum("gradient").alias("gradient"), F.sum("hessian").alias("hessian")).toArrow()
    sums = np.zeros((2, ends[-1]))
    sums[:, found["cell"].to_numpy()] = found["gradient"].to_numpy(), found["hessian"].to_numpy()
    return [sums[:, e - len(nodes) * w : e].reshape(2, len(nodes), w) for e, w in zip(ends, widths, strict=True)]


def _best_split(gradient: Sequence[np.ndarray], hessian: Sequence[np.ndarray], nominal: Sequence[bool]) -> tuple[int, list[int]] | None:
    """Feature and codes that go left of the best split of a node, by its sums for each code of each feature: the first of those that
    gain most. The codes of a nominal feature are put in order by their mean."""
    best, found = 0.0, None
    for j, (g, h) in enumerate(zip(gradient, hessian, strict=True)):
        there = np.flatnonzero(h > 0)
        if len(there) < 2:
            continue
        if nominal[j]:
            there = there[np.argsort(-g[there] / h[there], kind="stable")]
        gl, hl = np.cumsum(g[there])[:-1], np.cumsum(h[there])[:-1]
        all_g, all_h = g[there].sum(), h[there].sum()
        whole = all_g * all_g / all_h
        score = gl * gl / hl + (all_g - gl) ** 2 / np.maximum(all_h - hl, LEAST_HESSIAN)
        at = int(np.argmax(score >= score.max() * (1 - SAME_GAIN)))
        if score[at] - whole > best + SAME_GAIN * score[at]:
            left = there[: at + 1]
            best, found = score[at] - whole, (j, [int(c) for c in (left if nominal[j] else range(left[-1] + 1))])
    return found


class NewtonBoostedClassifier(_BoostedTrees):
    """Binary classifier trained by second-order steps on a loss of one's own, the focal loss by default.

    Each round grows a tree level by level, by the gradients and hessians summed over the rows of each node and feature value: one pass a
    level, whose rows are codes of a few bytes. A split is the one that a regression tree on ``-gradient / hessian``, weighted by
    the hessian, makes, of all that there are; then each leaf steps by ``-sum(gradient) / (sum(hessian) + penalty)``. ``terms(label, margin)`` gives gradient
    and hessian, ``loss(label, score)`` the loss of a row, whose mean by round is in ``history``. With ``validation`` the flagged
    rows train nothing, and training ends when ``patience`` rounds bring their mean loss no further down.
    """

    def __init__(
        self,
        *args: Any,
        terms: Terms = focal_terms,
        loss: Loss = focal_cross_entropy,
        rounds: int = 100,
        step: float = 0.1,
        depth: int = 5,
        penalty: float = 0.0,
        start: float = 0.0,
        patience: int = 5,
        seed: int = 42,
        **kwargs: Any,
    ):
        super().__init__(*args, **kwargs)
        if rounds < 1 or depth < 1 or step <= 0 or penalty < 0 or patience < 1:
            raise ValueError("rounds, depth and patience must be at least 1, step positive, penalty not negative")
        self.terms, self.loss = terms, loss
        self.limit, self.step, self.depth, self.penalty, self.start, self.patience, self.seed = rounds, step, depth, penalty, start, patience, seed
        self.trees: list[Tree] = []
        self.features: list[str] = []  # the columns of codes, in the order that trees know them by
        self.history: list[dict[str, float | None]] = []

    # -- training ------------------------------------------------------------------------------------
    def _train(self, table: DataFrame, stages: list, bins: int) -> PipelineModel:
        *stages, assembler = stages
        held = quoted(self.validation).cast("boolean") if self.validation else F.lit(False)
        table = materialise(table.withColumn("_held", held).where(F.col("_held").isNotNull()), "dealt")
        coder, widths = self._coder(table.where(~F.col("_held")), assembler.getInputCols())
        prepared = Pipeline(stages=[*stages, *coder]).fit(table)
        for stage in prepared.stages:
            if stage.hasParam("outputCols"):
                widths |= {c: len(labels) + 1 for c, labels in zip(stage.getOutputCols(), getattr(stage, "labelsArray", ()))}
        self.features = [c if c in widths else f"_code{c}" for c in assembler.getInputCols()]
        self.features = [c for c in self.features if c in widths]
        sizes = [widths[c] for c in self.features] or [1]
        kind = np.dtype(np.uint8 if max(sizes) <= 256 else np.int32)
        weight = F.col("_weight") if "_weight" in table.columns else F.lit(1.0)
        rows = prepared.transform(table).select(
            self._codes().alias("codes"), F.col("_label").alias("label"), weight.cast("double").alias("weight"), F.col("_held").alias("held"),
            F.lit(float(self.start)).alias("margin"),
        )
        spark = table.sparkSession
        path = scratch_path(spark, "margins")
        blocks = materialise(_packed(rows, self.terms, self.loss, kind), path=path)
        self.trees, self.history = [], []
        best, best_round = None, 0
        for n in range(self.limit):
            tree = self._grown(blocks, sizes, [c.startswith("_index_") for c in self.features] or [False], kind)
            self.trees.append(tree)
            before, path = path, scratch_path(spark, "margins")
            blocks = materialise(_moved(blocks, tree, self.step, self.terms, self.loss, kind), path=path)
            discard(spark, before)
            means = blocks.agg(*(F.try_divide(F.sum(f"{s}_loss"), F.sum(f"{s}_weight")).alias(s) for s in ("train", "held"))).first()
            self.history.append({"round": n + 1, "train": means["train"], "validation": means["held"]})
            if self.validation and means["held"] is not None:
                if best is None or means["held"] < best:
                    best, best_round = means["held"], n + 1
                elif n + 1 - best_round >= self.patience:
                    self.trees = self.trees[:best_round]
                    break
        discard(spark, path)
        return prepared

    def _coder(self, trained: DataFrame, inputs: Sequence[str]) -> tuple[list[Bucketizer], dict[str, int]]:
        """The stage that numbers the values of columns without categories, halfway between those trained on, and how many each has.
        A column of one value splits nothing and has no code."""
        numbers = [c for c in inputs if not c.startswith("_index_")]
        found = trained.agg(F.count("*"), *(F.collect_set(quoted(c)) for c in numbers)).first()  # at most the bins of each column
        if not found[0]:
            raise ValueError("no rows to train on")
        splits = {}
        for c, values in zip(numbers, found[1:], strict=True):
            values = sorted(set(values))
            if len(values) > 1:
                middles = [0.0 if a == -b else a / 2 + b / 2 for a, b in zip(values, values[1:])]
                # A value that is halfway goes with those below it.
                inner = [min(math.nextafter(m, math.inf), b, sys.float_info.max) for m, b in zip(middles, values[1:], strict=True)]
                splits[c] = [-math.inf, *inner, math.inf]
        if not splits:
            return [], {}
        names = [f"_code{c}" for c in splits]
        coder = Bucketizer(inputCols=list(splits), outputCols=names, splitsArray=list(splits.values()), handleInvalid="error")
        return [coder], {name: len(s) - 1 for name, s in zip(names, splits.values(), strict=True)}

    def _codes(self) -> Column:
        codes = [quoted(c).cast("int") for c in self.features]
        return F.array(*(codes or [F.lit(0)])).alias("_codes")

    def _grown(self, blocks: DataFrame, widths: Sequence[int], nominal: Sequence[bool], kind: np.dtype) -> Tree:
        tree, nodes = Tree({}, {}), [0]
        for level in range(self.depth):
            sums = _histograms(blocks, tree, nodes, widths, kind)
            found = {}
            for k, node in enumerate(nodes):
                gradient, hessian = [s[0, k] for s in sums], [s[1, k] for s in sums]
                g, h = gradient[0].sum(), hessian[0].sum()
                if not (math.isfinite(g) and math.isfinite(h)):
                    raise ValueError("gradients and hessians of training rows must be numbers: a label is missing, or the loss has none at a margin")
                tree.steps[node] = float(-g / (h + self.penalty))
                if split := _best_split(gradient, hessian, nominal):
                    found[node] = split
                    j, left = split
                    inside = np.isin(np.arange(widths[j]), left)
                    for child, mask in ((2 * node + 1, inside), (2 * node + 2, ~inside)):
                        tree.steps[child] = float(-gradient[j][mask].sum() / (hessian[j][mask].sum() + self.penalty))
            tree.splits |= found
            nodes = [child for node in found for child in (2 * node + 1, 2 * node + 2)]
            if not nodes:
                break
        return tree

    # -- scoring --------------------------------------------------------------------------------------
    @property
    def rounds(self) -> int:
        self._fitted()
        return len(self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``margin``, ``score`` and ``prediction``, which replace columns of the same name."""
        kept = [c for c in df.columns if c not in ("margin", "score", "prediction")]
        prepared = self._with_shares(self._prepare(df.select(*(quoted(c) for c in kept))))
        rows = self._fitted().transform(prepared).select(*(quoted(c) for c in kept), self._codes())
        rows = rows.select(*(quoted(c) for c in kept), (F.lit(float(self.start)) + _stepped(self.trees, self.step)(F.col("_codes"))).alias("_margin"))
        score = sigmoid("_margin")
        return rows.select(
            *(quoted(c) for c in kept), F.col("_margin").alias("margin"), score.alias("score"), (F.col("_margin") > 0).cast("double").alias("prediction")
        )

    def predict_proba(self, df: DataFrame, name: str = "score") -> DataFrame:
        return self._only(df, "score", name)

    def margins(self, df: DataFrame, name: str = "margin") -> DataFrame:
        return self._only(df, "margin", name)

    def _only(self, df: DataFrame, output: str, name: str) -> DataFrame:
        """``df`` with one output; its own columns stay, also those named like an output."""
        held = {c: f"_held_{i}" for i, c in enumerate(df.columns) if c in ("margin", "score", "prediction")}
        scored = self.transform(df.withColumnsRenamed(held))
        return scored.select(*(quoted(held.get(c, c)).alias(c) for c in df.columns if c != name), F.col(output).alias(name))

    def evaluate(self, df: DataFrame, metric: str = "roc_auc") -> float:
        if metric not in ("roc_auc", "accuracy", "loss"):
            raise ValueError(f"unsupported metric {metric!r}: use roc_auc, accuracy or loss")
        scored = self.transform(df)
        if metric == "roc_auc":
            return metrics.roc_auc(scored, self.label, "score").first()["roc_auc"]
        if metric == "accuracy":
            return metrics.accuracy(scored, self.label, "prediction").first()["accuracy"]
        return scored.agg(F.avg(self.loss(quoted(self.label).cast("double"), F.col("score")))).first()[0]

    def importances(self, top: int | None = None) -> DataFrame:
        raise NotImplementedError("trees of a loss of one's own have no importances")

    # -- storage ----------------------------------------------------------------------------------------
    def _config(self) -> dict[str, Any]:
        own = {
            "rounds": self.limit, "step": self.step, "depth": self.depth, "penalty": self.penalty, "start": self.start,
            "patience": self.patience, "seed": self.seed,
        }
        return {**super()._config(), **own}

    def save(self, path: str) -> None:
        """As other models, and each tree as one JSON line a round."""
        super().save(path)
        spark = SparkSession.getActiveSession()
        lines = [(-1, json.dumps(self.features))]
        lines += [(n, json.dumps([list(tree.splits.items()), list(tree.steps.items())])) for n, tree in enumerate(self.trees)]
        spark.createDataFrame(lines, "round int, tree string").coalesce(1).write.mode("overwrite").json(f"{path}/trees")

    @classmethod
    def load(cls, path: str, terms: Terms = focal_terms, loss: Loss = focal_cross_entropy) -> NewtonBoostedClassifier:
        """The stored model; a loss of one's own is code and has to be given again to train or to judge by it."""
        loaded = super().load(path)
        loaded.terms, loaded.loss = terms, loss
        lines = SparkSession.getActiveSession().read.schema("round int, tree string").json(f"{path}/trees").collect()
        loaded.features, *trees = [json.loads(r["tree"]) for r in sorted(lines, key=lambda r: r["round"])]
        loaded.trees = [Tree({i: (j, left) for i, (j, left) in splits}, dict(steps)) for splits, steps in trees]
        return loaded


def loss_by_round(model: NewtonBoostedClassifier) -> DataFrame:
    """(round, train, validation): mean losses after each round."""
    rows: Sequence[tuple] = [(h["round"], h["train"], h["validation"]) for h in model.history]
    return SparkSession.getActiveSession().createDataFrame(rows, "round int, train double, validation double")

"""Seeded random search over parameters, scored by cross-validation (HPO-1..6)."""

from __future__ import annotations

import logging
import math
import random
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from contextlib import nullcontext
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from riskflow.operators.sampling import hashed_folds, stratified_folds
from riskflow.session import materialise, scratch_scope, spread

log = logging.getLogger(__name__)

Suggest = Callable[[random.Random], Any]
Trainer = Callable[[DataFrame, dict[str, Any]], Any]
Scorer = Callable[[Any, DataFrame], float]

WORST = {"maximize": -1.0, "minimize": 1e10}
TRIALS_SCHEMA = "number int, value double, params map<string,string>, state string"


@dataclass
class Trial:
    number: int
    value: float
    params: dict[str, Any] = field(default_factory=dict)
    state: str = "complete"


class RandomSearch:
    """Draws parameter sets on the driver; every trial is a set of Spark jobs over the whole table."""

    def __init__(
        self, trials: int = 100, folds: int = 5, seed: int = 42, timeout: float | None = None, parallelism: int = 1,
        concurrent: int = 1,
    ):
        if trials < 1:
            raise ValueError("trials must be at least 1")
        if folds < 2:
            raise ValueError("folds must be at least 2")
        if concurrent < 1:
            raise ValueError("concurrent must be at least 1")
        self.trials, self.folds, self.seed, self.timeout = trials, folds, seed, timeout
        self.parallelism = parallelism  # folds trained at once
        self.concurrent = concurrent  # trials run at once
        self.direction = "maximize"
        self.results: list[Trial] | None = None

    def optimize(
        self,
        objective: Callable[[dict[str, Any]], float],
        space: Mapping[str, Suggest],
        direction: str = "maximize",
    ) -> tuple[dict[str, Any], float]:
        """Run the trials; a trial that fails gets the worst score and the search goes on.

        Parameters are drawn in order of the trials, so they don't depend on which trial ends first. ``concurrent`` trials
        run at a time, each in a scheduler pool of its own. Past the time limit no trial is begun (the first always is), the
        Spark jobs of those that run are cancelled, and they end as ``stopped``, with the worst score. Returns the best
        parameters and their score.
        """
        if direction not in WORST:
            raise ValueError("direction must be maximize or minimize")
        self.direction, self.results = direction, []
        rng, started = random.Random(self.seed), time.monotonic()
        spark = SparkSession.getActiveSession()
        tag = f"search-{uuid.uuid4().hex}"

        def late() -> bool:
            return self.timeout is not None and time.monotonic() - started > self.timeout

        def run(n: int, params: dict[str, Any]) -> Trial:
            if spark is not None:
                spark.sparkContext.addJobTag(tag)
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{n % self.concurrent}")
            try:
                with scratch_scope(spark) if spark is not None else nullcontext():  # what a trial writes goes with it
                    value = float(objective(params))
                if math.isnan(value):
                    raise ValueError("the objective is not a number")
                return Trial(n, value, params)
            except Exception as error:
                log.warning("trial %d failed: %s", n, error)
                return Trial(n, WORST[direction], params, "stopped" if late() else "failed")
            finally:
                if spark is not None:
                    spark.sparkContext.removeJobTag(tag)
                    spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

        begin = inheritable_thread_target(spark)(run) if spark is not None else run
        running, n = set(), 0
        with ThreadPoolExecutor(self.concurrent) as pool:
            while True:
                while n < self.trials and len(running) < self.concurrent and not (n and late()):
                    running.add(pool.submit(begin, n, {name: suggest(rng) for name, suggest in space.items()}))
                    n += 1
                if not running:
                    break
                done, running = wait(running, timeout=self._until(started), return_when=FIRST_COMPLETED)
                self.results += [trial.result() for trial in done]
                if running and late() and spark is not None:
                    spark.sparkContext.cancelJobsWithTag(tag)  # again for jobs that a trial begins meanwhile
        self.results.sort(key=lambda t: t.number)
        best = self._ordered()[0]
        return best.params, best.value

    def _until(self, started: float) -> float | None:
        """Seconds to wait for a trial: until the limit, then in short turns."""
        return None if self.timeout is None else max(started + self.timeout - time.monotonic(), 0.1)

    def optimize_model(
        self,
        df: DataFrame,
        label: str,
        key: str,
        train: Trainer,
        score: Scorer,
        space: Mapping[str, Suggest],
        direction: str = "maximize",
        exact_folds: bool = True,
    ) -> tuple[dict[str, Any], float]:
        """Score each parameter set by the mean over stratified folds.

        ``train(rows, params)`` returns a model, ``score(model, rows)`` a number. The fold column is
        computed and written once, and read by all trials.
        """
        folded = (
            stratified_folds(df, label, key, self.folds, self.seed, "_fold")
            if exact_folds
            else hashed_folds(df, key, self.folds, self.seed, "_fold")
        )
        table = spread(materialise(folded, "folds"))

        def one_fold(fold: int, params: dict[str, Any]) -> float:
            model = train(table.where(F.col("_fold") != fold).drop("_fold"), params)
            return score(model, table.where(F.col("_fold") == fold).drop("_fold"))

        def objective(params: dict[str, Any]) -> float:
            with ThreadPoolExecutor(self.parallelism) as pool:
                run = inheritable_thread_target(df.sparkSession)(lambda fold: one_fold(fold, params))
                values = list(pool.map(run, range(self.folds)))
            return sum(values) / len(values)

        return self.optimize(objective, space, direction)

    def _ordered(self) -> list[Trial]:
        if not self.results:
            raise RuntimeError("no trials yet: run optimize or optimize_model first")
        sign = -1.0 if self.direction == "maximize" else 1.0
        return sorted(self.results, key=lambda t: (sign * t.value, t.number))

    def trials_table(self) -> DataFrame:
        """(number, value, params, state): one row per trial."""
        self._ordered()
        rows = [(t.number, t.value, {k: str(v) for k, v in t.params.items()}, t.state) for t in self.results]
        return SparkSession.getActiveSession().createDataFrame(rows, TRIALS_SCHEMA)

    def top_trials(self, n: int = 10) -> DataFrame:
        """The best ``n`` trials, ties by number."""
        better = F.desc("value") if self.direction == "maximize" else F.asc("value")
        return self.trials_table().orderBy(better, "number").limit(n)

    def best_trial(self) -> dict[str, Any]:
        best = self._ordered()[0]
        return {"number": best.number, "score": best.value, "params": best.params}

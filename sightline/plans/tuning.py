"""Parameter search: trials are rows, run side by side over the same cases."""

from __future__ import annotations

import json
import math
import os
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from ..errors import SightlineError, require
from ..operators import tracking
from .runner import evaluate

#: Metrics of which less is better.
MINIMISED = {"FP", "FN", "IDSW", "FPPF", "Frag", "ML", "ms_per_frame"}


def direction_of(metric: str) -> str:
    return "minimize" if metric in MINIMISED else "maximize"


@dataclass(frozen=True)
class FloatRange:
    low: float
    high: float
    log: bool = False
    step: float | None = None

    def __post_init__(self) -> None:
        require(self.low < self.high and not (self.log and (self.low <= 0 or self.step)), f"not a range: {self}")

    def at(self, share: float) -> float:
        if self.log:
            return math.exp(math.log(self.low) + share * math.log(self.high / self.low))
        value = self.low + share * (self.high - self.low)
        return self.low + round((value - self.low) / self.step) * self.step if self.step else value


@dataclass(frozen=True)
class IntRange:
    low: int
    high: int
    step: int = 1

    def __post_init__(self) -> None:
        require(self.low < self.high and self.step >= 1, f"not a range: {self}")

    def at(self, share: float) -> int:
        return min(self.high, self.low + self.step * int(share * ((self.high - self.low) // self.step + 1)))


@dataclass(frozen=True)
class Choice:
    choices: tuple

    def __post_init__(self) -> None:
        require(len(self.choices) >= 2, "a choice needs two values")

    def at(self, share: float):
        return self.choices[min(len(self.choices) - 1, int(share * len(self.choices)))]


@dataclass(frozen=True)
class Space:
    """The parameters of a tracker to search, and those held."""

    tracker: str
    parameters: dict
    constants: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        unknown = (set(self.parameters) | set(self.constants)) - tracking.accepted_parameters(self.tracker)
        require(not unknown, f"{self.tracker} takes no {sorted(unknown)}")
        require(not set(self.parameters) & set(self.constants), "a parameter is either searched or held")

    def at(self, shares) -> dict:
        return {**self.constants, **{n: r.at(float(s)) for (n, r), s in zip(sorted(self.parameters.items()), shares)}}

    def middle(self) -> dict:
        return self.at([0.5] * len(self.parameters))


_LIFE = {"max_age": IntRange(10, 60), "min_hits": IntRange(1, 5)}
_BYTE = {**_LIFE, "low_threshold": FloatRange(0.05, 0.25), "track_threshold": FloatRange(0.3, 0.8), "match_threshold": FloatRange(0.1, 0.5), "second_match_threshold": FloatRange(0.3, 0.7)}
_BOT = {**_BYTE, "appearance_gate": FloatRange(0.1, 0.5), "appearance_weight": FloatRange(0.2, 1.0), "embedding_momentum": FloatRange(0.7, 0.98)}
SPACES = {
    "sort": {**_LIFE, "det_threshold": FloatRange(0.2, 0.8), "iou_threshold": FloatRange(0.1, 0.5)},
    "bytetrack": _BYTE,
    "botsort": _BOT,
    "mcbyte": {**_BOT, "lock_clear_matches": Choice((True, False))},
    "ocsort": {**_LIFE, "det_threshold": FloatRange(0.2, 0.8), "iou_threshold": FloatRange(0.1, 0.5), "momentum_weight": FloatRange(0.0, 0.5), "delta_t": IntRange(1, 5), "recovery_iou_threshold": FloatRange(0.2, 0.7)},
    "deepsortv2": {**_LIFE, "det_threshold": FloatRange(0.2, 0.8), "appearance_gate": FloatRange(0.05, 0.4), "stage_a_max_cost": FloatRange(0.3, 0.7), "stage_b_max_cost": FloatRange(0.4, 0.8), "stage_c_max_cost": FloatRange(0.4, 0.9), "stage_d_max_cost": FloatRange(0.4, 0.9), "giou_gate": FloatRange(0.8, 1.6)},
}


def space_for(tracker: str) -> Space:
    name = tracking.ALIASES.get(tracker, tracker)
    require(name in SPACES, f"no space for {tracker!r}")
    return Space(name, SPACES[name])


@dataclass
class Study:
    """The default parameters' score beside the best found."""

    tracker: str
    metric: str
    baseline: float
    best: float
    best_params: dict
    trials: int
    invalid: int

    @property
    def improvement(self) -> float:
        return self.best - self.baseline if direction_of(self.metric) == "maximize" else self.baseline - self.best

    def summary(self) -> str:
        return f"{self.tracker} {self.metric}: {self.baseline:.4f} by default, {self.best:.4f} with {self.best_params} ({self.trials} trials, {self.invalid} invalid)"


def run_study(
    tracker: str,
    case: dict[str, DataFrame],
    *,
    space: Space | None = None,
    metric: str = "HOTA",
    trials: int = 30,
    seed: int = 0,
    threshold: float = 0.5,
    jobs: int = 1,
    timeout: float | None = None,
    store: str | None = None,
) -> Study:
    """A seeded search that fills the space evenly (a Latin hypercube), each trial on summed counts of all sequences.

    A trial is a Spark job over all cameras; its parameters are a few numbers, and
    `jobs` trials run at once. After `timeout` seconds no trial begins. `store`
    names a file of the driver that keeps each finished trial as a line of JSON; a
    study that is begun again with it takes those over. The best is the first of
    equals.
    """
    require(jobs >= 1, f"jobs must be 1 or more, got {jobs}")
    space = space or space_for(tracker)
    rng = np.random.default_rng(seed)
    shares = np.stack([(rng.permutation(trials) + rng.random(trials)) / max(trials, 1) for _ in space.parameters], axis=1) if trials else np.zeros((0, len(space.parameters)))
    plan = [dict(space.constants), *(space.at(row) for row in shares)]
    name = lambda parameters: json.dumps([space.tracker, metric, threshold, parameters], sort_keys=True, default=str)
    done = _stored(store)
    began, writing = time.monotonic(), threading.Lock()

    def scored(number: int) -> float | None:
        """The metric; NaN for parameters that are refused; None if there was no time."""
        key = name(plan[number])
        if key not in done:
            if number and timeout is not None and time.monotonic() - began > timeout:
                return None
            try:
                row = evaluate(case, tracker, threshold=threshold, **plan[number]).where("sequence = 'COMBINED'").first()
                value = float(row[metric])
            except SightlineError:
                if not number:
                    raise
                value = float("nan")
            with writing:
                done[key] = value
                if store:
                    with open(store, "a") as out:
                        out.write(json.dumps([key, value]) + "\n")
        return done[key]

    direction = 1 if direction_of(metric) == "maximize" else -1
    baseline = scored(0)
    with ThreadPoolExecutor(jobs) as pool:
        values = list(pool.map(scored, range(1, len(plan))))
    best, best_params = baseline, plan[0]
    for value, parameters in zip(values, plan[1:]):
        if value is not None and not np.isnan(value) and direction * value > direction * best:
            best, best_params = value, parameters
    ran = [v for v in values if v is not None]
    return Study(tracker, metric, baseline, best, best_params, len(ran), sum(bool(np.isnan(v)) for v in ran))


def _stored(store: str | None) -> dict[str, float]:
    if not store or not os.path.exists(store):
        return {}
    with open(store) as lines:
        return dict(json.loads(line) for line in lines if line.strip())

"""Named components: classes or "module:name" targets under names and aliases."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import Any

from .errors import ParameterError


class Registry:
    """One family of components."""

    def __init__(self, family: str) -> None:
        self.family = family
        self._targets: dict[str, Any] = {}
        self._aliases: dict[str, str] = {}

    def add(self, name: str, target: Any, aliases: tuple[str, ...] = ()) -> None:
        """Register a class, a function, or a "module:name" string that is loaded when first asked for."""
        for n in (name, *aliases):
            if n in self._targets or n in self._aliases:
                raise ParameterError(f"{self.family} {n!r} is registered already")
        self._targets[name] = target
        self._aliases.update(dict.fromkeys(aliases, name))

    def register(self, name: str, aliases: tuple[str, ...] = ()) -> Callable[[Any], Any]:
        def keep(target: Any) -> Any:
            self.add(name, target, aliases)
            return target

        return keep

    def backends(self, name: str) -> list[str]:
        """Where a component runs: this library has one home for each, Spark; none for an unknown name."""
        return ["spark"] if name in self else []

    def names(self) -> list[str]:
        return sorted(self._targets)

    def get(self, name: str) -> Any:
        key = self._aliases.get(name, name)
        if key not in self._targets:
            raise ParameterError(f"no {self.family} {name!r}; there are {self.names()}")
        target = self._targets[key]
        if isinstance(target, str):
            module, _, attribute = target.partition(":")
            target = self._targets[key] = getattr(importlib.import_module(module), attribute)
        return target

    def build(self, name: str, **parameters: Any) -> Any:
        return self.get(name)(**parameters)

    def __contains__(self, name: str) -> bool:
        return name in self._targets or name in self._aliases


TRACKERS = Registry("tracker")
for _name, _target, _aliases in (
    ("sort", "Sort", ()), ("bytetrack", "ByteTrack", ("byte",)), ("botsort", "BotSort", ("bot", "bot_sort")), ("mcbyte", "McByte", ("mcb", "mc_byte")),
    ("ocsort", "OcSort", ("oc", "oc_sort")), ("deepsortv2", "DeepSort2", ("deepsort2", "dsv2")),
):
    TRACKERS.add(_name, f"sightline.operators.tracking:{_target}", _aliases)
CROSS_CAMERA = Registry("cross-camera tracker")
CROSS_CAMERA.add("cluster", "sightline.operators.crosscamera:CrossCamera", ("vtx",))
MATCHERS = Registry("matcher")
for _name, _aliases in (("appearance", ("aic",)), ("spatial", ()), ("gated", ("spatial_gating",))):
    MATCHERS.add(_name, f"sightline.operators.crosscamera:{_name}", _aliases)
CLUSTERERS = Registry("clusterer")
CLUSTERERS.add("agglomerative", "sightline.operators.crosscamera:average_linkage", ("average_linkage", "aic"))
GALLERIES = Registry("gallery")
GALLERIES.add("flat", "sightline.operators.retrieval:retained")
GALLERIES.add("online", "sightline.operators.retrieval:OnlineCentroids")
GALLERIES.add("centroid", "sightline.operators.retrieval:centroids", ("prototype",))
AGGREGATORS = Registry("aggregator")
AGGREGATORS.add("mean", "sightline.operators.aggregate:mean", ("average",))
AGGREGATORS.add("ema", "sightline.operators.aggregate:ema", ("exponential",))
HEADS = Registry("head")
HEADS.add("yolo26", "sightline.operators.detection:decode", ("yolo26-det", "end2end"))
HEADS.add("yolo26_seg", "sightline.operators.detection:masks", ("yolo26-seg", "yolo26seg"))
IMAGE_OPS = Registry("image operation")
for _name in ("letterbox", "crops", "nv12_letterbox"):
    IMAGE_OPS.add(_name, f"sightline.functions.imaging:{_name}")
MOTIONS = Registry("camera motion")
MOTIONS.add("none", "sightline.contracts:FixedCamera", ("fixed",))
MOTIONS.add("external", "sightline.contracts:Telemetry", ("telemetry", "ptz"))
RUNNING = Registry("running aggregate")
RUNNING.add("mean", "sightline.contracts:RunningMean", ("average",))
RUNNING.add("ema", "sightline.contracts:MovingAverage", ("exponential",))

"""Typed properties with ranges and JSON in and out, as the programs' settings are given."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields


def prop(default, low=None, high=None, read_only: bool = False):
    return field(default=default, metadata={"low": low, "high": high, "read_only": read_only})


class Properties:
    """Base of settings: get and set by name within range, JSON both ways; unknown names are reported, not taken."""

    def set(self, name: str, value) -> None:
        f = next((f for f in fields(self) if f.name == name), None)
        if f is None:
            raise KeyError(name)
        if f.metadata.get("read_only"):
            raise AttributeError(f"{name} is read-only")
        kind, low, high = type(f.default), f.metadata.get("low"), f.metadata.get("high")
        value = kind(value)
        if low is not None and value < low or high is not None and value > high:
            raise ValueError(f"{name} = {value} is not within {low} and {high}")
        setattr(self, name, value)

    def load(self, text: str) -> list[str]:
        """Set what the JSON object names; returns the names that are unknown."""
        given = json.loads(text)
        known = {f.name for f in fields(self)}
        for k, v in given.items():
            if k in known:
                self.set(k, v)
        return sorted(set(given) - known)

    def dump(self) -> str:
        return json.dumps({f.name: getattr(self, f.name) for f in fields(self)})


@dataclass
class TrainerProperties(Properties):
    """The trainer's defaults and ranges."""

    n_pixels: int = prop(2000, 1)
    n_thresholds: int = prop(49, 1)
    threshold_range: float = prop(0.645)
    threshold_power: float = prop(1.0)
    n_uvs: int = prop(2000, 1)
    uv_range: float = prop(0.4041)
    uv_power: float = prop(1.0)
    max_depth: int = prop(20, 2, 30)
    max_nodes: int = prop(0, 0)
    batch_divider: int = prop(1, 1)
    batch_number: int = prop(0, 0)
    seed: int = prop(0)


@dataclass
class TrackingProperties(Properties):
    """The tracker's defaults."""

    near: float = prop(0.5)
    far: float = prop(3.5)
    clamp_far: bool = prop(False)
    segment_resolution: int = prop(1, 1)
    edge_threshold: float = prop(0.99)
    cluster_tolerance: float = prop(0.05)
    floor_threshold: float = prop(0.1)
    tiny_cluster: int = prop(10, 1)
    large_cluster: int = prop(200, 1)
    max_people: int = prop(1, 1, 4)
    reliability_frames: int = prop(6, 1)
    reliability_threshold: float = prop(0.5)
    joint_velocity: float = prop(1.5)
    outlier_factor: float = prop(2.0)
    prediction_max_delta_ms: float = prop(100.0)
    prediction_decay: float = prop(1.0)
    max_history: int = prop(12, 1)

"""Dataset configuration: TOML in and out, rules, presets, identity."""

from __future__ import annotations

import hashlib
import math
import struct
import tomllib
from copy import deepcopy
from typing import Any

#: The schema: section, field, kind (a type, or the values allowed), default (... if there is none). The order is that of the identity hash.
SCENE = (
    ("resolution", int, ...), ("n_shapes", int, ...), ("trajectory_complexity", int, ...), ("event_duration_frames", int, ...), ("easing_family", ("linear", "ease_in", "ease_out", "ease_in_out"), ...),
    ("n_motion_slots", int, ...), ("motion_events_per_shape", list, []), ("n_motion_events_total", int, None), ("allow_simultaneous", bool, ...),
    ("shape_identity_assignment", ("index_locked", "pair_unique_random"), "index_locked"), ("randomize_motion_events_per_shape", bool, False), ("motion_events_per_shape_random_ranges", list, None),
    ("sound_sample_rate_hz", int, ...), ("sound_frames_per_second", int, ...), ("sound_modulation_depth_per_mille", int, ...), ("sound_channel_mapping", ("mono_mix", "stereo_alternating"), ...),
    ("text_reference_frame", ("canonical", "relative", "mixed"), "canonical"), ("text_synonym_rate", float, 0.0), ("text_typo_rate", float, 0.0),
    ("video_keyframe_border", bool, False), ("image_frame_scatter", bool, False), ("image_arrow_type", ("prev", "current", "next"), "next"),
)
LANDSCAPE = (("x_nonlinearity", ("sigmoid", "tanh"), ...), ("y_nonlinearity", ("sigmoid", "tanh"), ...), ("x_steepness", float, ...), ("y_steepness", float, ...))
GRAPH = (("site_k", int, ...), ("lambda2_min", float, ...), ("validation_scene_count", int, ...), ("lambda2_iterations", int, ...))
SECTIONS = {"scene": SCENE, "positional_landscape": LANDSCAPE, "site_graph": GRAPH, "parallelism": (("num_threads", int, ...),)}
#: Limits and the version of the schema.
SCHEMA_VERSION, SEED_SPACE = 1, 65_536
#: Presets as shapes, complexity, steepness of x and y, reference frame, synonym rate, typo rate, neighbours.
PRESETS = {
    "standard": (2, 2, 3.0, 2.0, "canonical", 0.0, 0.0, 10), "hardness": (4, 4, 1.0, 1.0, "canonical", 0.0, 0.0, 10), "obstruction": (2, 1, 8.0, 8.0, "mixed", 0.4, 0.02, 10),
    "non_transitivity": (3, 3, 3.0, 3.0, "canonical", 0.15, 0.01, 10), "bridging": (3, 3, 2.0, 2.0, "canonical", 0.08, 0.0, 10), "spectral_gap": (2, 2, 2.5, 2.5, "canonical", 0.0, 0.0, 3),
}
#: A small valid configuration to start from.
DEFAULT = """
schema_version = 1
master_seed = 42
[scene]
resolution = 512
n_shapes = 3
trajectory_complexity = 2
event_duration_frames = 24
easing_family = "ease_in_out"
n_motion_slots = 12
motion_events_per_shape = [3, 4, 5]
allow_simultaneous = true
sound_sample_rate_hz = 8000
sound_frames_per_second = 24
sound_modulation_depth_per_mille = 250
sound_channel_mapping = "stereo_alternating"
[positional_landscape]
x_nonlinearity = "sigmoid"
y_nonlinearity = "tanh"
x_steepness = 3.0
y_steepness = 2.0
[parallelism]
num_threads = 4
[site_graph]
site_k = 10
lambda2_min = 0.05
validation_scene_count = 32
lambda2_iterations = 64
"""


class ConfigError(ValueError):
    pass


class Config:
    """A configuration as nested dictionaries; setting a value that breaks a rule changes nothing."""

    def __init__(self, data: dict[str, Any], check: bool = True):
        self.data: dict[str, Any] = {"schema_version": data.get("schema_version"), "master_seed": data.get("master_seed")}
        if "generation_profile" in data:
            self.data["generation_profile"] = dict(data["generation_profile"])
        for section, fields in SECTIONS.items():
            given = data.get(section)
            if not isinstance(given, dict):
                raise ConfigError(f"section {section} is missing")
            self.data[section] = {}
            for name, kind, default in fields:
                value = given.get(name, default)
                if value is ...:
                    raise ConfigError(f"{section}.{name} is missing")
                if isinstance(kind, tuple) and value not in kind:
                    raise ConfigError(f"{section}.{name} must be one of {', '.join(kind)}")
                if kind is float and isinstance(value, int):
                    value = float(value)
                if isinstance(kind, type) and value is not None and (not isinstance(value, kind) or (kind is int and isinstance(value, bool))):
                    raise ConfigError(f"{section}.{name} must be of type {kind.__name__}")
                self.data[section][name] = deepcopy(value)
        if check:
            self.validate()

    @classmethod
    def from_toml(cls, text: str = DEFAULT) -> Config:
        return cls(tomllib.loads(text))

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, "rb") as f:
            return cls(tomllib.load(f))

    def __getitem__(self, key: str) -> Any:
        section, _, name = key.partition(".")
        return self.data[section][name] if name else self.data[section]

    def replaced(self, **values: Any) -> Config:
        """A copy with values changed, given as section__field."""
        data = deepcopy(self.data)
        for key, value in values.items():
            section, _, name = key.partition("__")
            if name:
                data[section][name] = value
            else:
                data[section] = value
        return Config({k: v for k, v in data.items() if v is not None})

    def capacity(self) -> int:
        """How many events fit: a slot holds one event, or one of each shape."""
        scene = self.data["scene"]
        return scene["n_motion_slots"] * (scene["n_shapes"] if scene["allow_simultaneous"] else 1)

    def faults(self):
        """What breaks a rule, in order."""
        s, p, gr = (self.data[k] for k in ("scene", "positional_landscape", "site_graph"))
        seed = self.data["master_seed"]
        share = lambda x: math.isfinite(x) and 0 <= x <= 1
        positive = lambda x: math.isfinite(x) and x > 0
        rules = [
            (isinstance(seed, int) and 0 <= seed < SEED_SPACE, "master_seed is out of range"), (self.data["schema_version"] == SCHEMA_VERSION, "schema_version is not supported"),
            (1 <= s["n_shapes"] <= 6, "n_shapes must be 1 to 6"), (1 <= s["trajectory_complexity"] <= 4, "trajectory_complexity must be 1 to 4"),
            *((s[f] > 0, f"{f} must be positive") for f in ("resolution", "event_duration_frames", "n_motion_slots", "sound_sample_rate_hz", "sound_frames_per_second")),
            (0 <= s["sound_modulation_depth_per_mille"] <= 1000, "sound_modulation_depth_per_mille must be at most 1000"),
            *((share(s[f]), f"{f} must be from 0 to 1") for f in ("text_synonym_rate", "text_typo_rate")), (self.data["parallelism"]["num_threads"] > 0, "num_threads must be positive"),
            *((positive(p[f]), f"{f} must be positive") for f in ("x_steepness", "y_steepness")), (gr["site_k"] > 0, "site_k must be positive"), (positive(gr["lambda2_min"]), "lambda2_min must be positive"),
            (gr["validation_scene_count"] >= 2, "validation_scene_count must be at least 2"), (gr["site_k"] < gr["validation_scene_count"], "site_k must be less than validation_scene_count"),
            (gr["lambda2_iterations"] > 0, "lambda2_iterations must be positive"),
        ]
        yield from (message for fine, message in rules if not fine)
        counts, ranges, cap, room, slots = s["motion_events_per_shape"], s["motion_events_per_shape_random_ranges"], s["n_motion_events_total"], self.capacity(), s["n_motion_slots"]
        if cap is not None and cap > room:
            yield "n_motion_events_total exceeds the capacity"
        if ranges is not None:
            if not s["randomize_motion_events_per_shape"]:
                yield "random ranges need randomize_motion_events_per_shape"
            elif counts:
                yield "both counts and random ranges are given"
            elif len(ranges) != s["n_shapes"]:
                yield "random ranges and shapes differ in number"
            else:
                yield from (f"random range {i} is empty or exceeds the slots" for i, r in enumerate(ranges) if not 0 <= r["min"] <= r["max"] <= slots)
                if sum(r["min"] for r in ranges) > min(room, cap if cap is not None else room):
                    yield "the least random counts exceed the budget"
            return
        if len(counts) != s["n_shapes"] and (counts or not s["randomize_motion_events_per_shape"]):
            yield "counts and shapes differ in number"
        yield from (f"count {i} exceeds the slots" for i, n in enumerate(counts) if n > slots)
        if not s["randomize_motion_events_per_shape"] and sum(counts) > min(room, cap if cap is not None else room):
            yield "counts exceed the capacity or the total"

    def validate(self) -> None:
        """Raise for the first broken rule."""
        for fault in self.faults():
            raise ConfigError(fault)

    def preset(self, name: str) -> Config:
        """This configuration under a preset: explicit counts, as many for each shape as the first has now. Presets that don't fit their slots are rejected."""
        shapes, complexity, sx, sy, frame, synonyms, typos, k = PRESETS[name]
        per_shape = (self["scene.motion_events_per_shape"] or [0])[0]
        data = deepcopy(self.data)
        data["scene"] |= {
            "n_shapes": shapes, "motion_events_per_shape": [per_shape] * shapes, "n_motion_events_total": None, "randomize_motion_events_per_shape": False, "motion_events_per_shape_random_ranges": None,
            "trajectory_complexity": complexity, "text_reference_frame": frame, "text_synonym_rate": synonyms, "text_typo_rate": typos,
        }
        data["positional_landscape"] |= {"x_steepness": sx, "y_steepness": sy}
        data["site_graph"] |= {"site_k": k, "validation_scene_count": max(data["site_graph"]["validation_scene_count"], k + 1)}
        return Config(data | {"generation_profile": {"name": name, "version": 1}})

    def to_toml(self) -> str:
        def text(v: Any) -> str:
            if isinstance(v, bool):
                return str(v).lower()
            if isinstance(v, str):
                return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
            if isinstance(v, list):
                return "[" + ", ".join(map(text, v)) + "]"
            if isinstance(v, dict):
                return "{ " + ", ".join(f"{k} = {text(x)}" for k, x in v.items()) + " }"
            return repr(v)

        top = [f"{k} = {text(v)}" for k, v in self.data.items() if not isinstance(v, dict)]
        for section, values in self.data.items():
            if isinstance(values, dict):
                top += ["", f"[{section}]", *(f"{k} = {text(v)}" for k, v in values.items() if v is not None)]
        return "\n".join(top) + "\n"

    def hash(self) -> str:
        """SHA-256 of the configuration without seed and schema version, in canonical binary form."""
        profile = {"generation_profile": self.data["generation_profile"]} if "generation_profile" in self.data else {}
        kept = {k: {f: v for f, v in self.data[k].items() if v is not None} for k in ("scene", "positional_landscape", "site_graph", "parallelism")} | profile
        return hashlib.sha256(cbor(kept)).hexdigest()

    def identity(self) -> dict[str, Any]:
        return {"master_seed": self.data["master_seed"], "config_hash": self.hash(), "generation_profile": self.data.get("generation_profile")}


def cbor(value: Any) -> bytes:
    """Concise binary object representation: maps in their own order, floats in the shortest form that keeps their value."""

    def head(major: int, n: int) -> bytes:
        for code, size, form in ((24, 1 << 8, ">B"), (25, 1 << 16, ">H"), (26, 1 << 32, ">I"), (27, 1 << 64, ">Q")):
            if n < 24:
                return bytes([major << 5 | n])
            if n < size:
                return bytes([major << 5 | code]) + struct.pack(form, n)
        raise OverflowError(n)

    if value is None or isinstance(value, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[value]
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, float):
        for mark, form in ((b"\xf9", ">e"), (b"\xfa", ">f")):
            try:
                if struct.unpack(form, raw := struct.pack(form, value))[0] == value:
                    return mark + raw
            except OverflowError:
                pass
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, str):
        return head(3, len(value.encode())) + value.encode()
    if isinstance(value, dict):
        return head(5, len(value)) + b"".join(cbor(k) + cbor(v) for k, v in value.items())
    return head(4, len(value)) + b"".join(map(cbor, value))

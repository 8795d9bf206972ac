"""Run configuration: YAML-like dictionaries with inheritance, placeholders and path defaults. Driver only."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field, fields
from pathlib import Path

try:
    import yaml
except ImportError:  # JSON is read without it
    yaml = None


def deep_merge(base: dict, over: dict) -> dict:
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load_raw(path: str | Path, seen: tuple = ()) -> dict:
    """A file's settings over those of the file it extends; a cycle is an error."""
    path = Path(path).resolve()
    if path in seen:
        raise ValueError(f"{path} extends itself")
    text = path.read_text(encoding="utf-8")
    raw = json.loads(text) if path.suffix == ".json" else (yaml.safe_load(text) if yaml else _no_yaml(path))
    base = (raw or {}).pop("extends", None)
    return deep_merge(load_raw(path.parent / base, (*seen, path)), raw) if base else raw or {}


def _no_yaml(path: Path):
    raise RuntimeError(f"{path}: reading YAML needs the yaml package; use a .json file")


def interpolate(value, names: dict[str, str]):
    """Known {placeholders} replaced in all strings; unknown ones stay."""
    if isinstance(value, dict):
        return {k: interpolate(v, names) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolate(v, names) for v in value]
    if isinstance(value, str):
        for k, v in names.items():
            value = value.replace("{" + k + "}", str(v))
    return value


def remap_output(path: str, root: str | None) -> str:
    """A relative path under outputs/ moved below the root."""
    p = path.replace("\\", "/")
    return f"{root.rstrip('/')}/{p.removeprefix('outputs/')}" if root and p.startswith("outputs/") else path


def format_prompt(template: str, **names: str) -> str:
    """Placeholders filled in; doubled braces stand for themselves."""
    left, right = "\x00", "\x01"
    out = template.replace("{{", left).replace("}}", right)
    for k, v in names.items():
        out = out.replace("{" + k + "}", str(v))
    return out.replace(left, "{").replace(right, "}")


@dataclass
class Data:
    manifest_path: str = "data/manifest.jsonl"
    training_manifest_path: str | None = None
    inference_manifest_path: str | None = None
    label_path: str | None = None
    output_path: str = "outputs/labels.jsonl"
    prediction_path: str = "outputs/predictions.jsonl"
    reference_path: str | None = None
    evaluation_path: str | None = None
    max_samples: int | None = None
    validation_ratio: float = 0.1
    seed: int = 42

    def labels(self) -> str:
        return self.label_path or self.output_path

    def full_labels(self) -> str:
        p = Path(self.labels())
        return str(p.with_name(f"{p.stem}_full{p.suffix}"))

    def training(self) -> str:
        return self.training_manifest_path or self.manifest_path

    def inference(self) -> str:
        return self.inference_manifest_path or self.training()

    def reference(self) -> str:
        return self.reference_path or self.evaluation_path or self.labels()


@dataclass
class Config:
    data: Data = field(default_factory=Data)
    prompt: str = "{query}"
    backend: str = "mock"
    experiments: list = field(default_factory=list)
    options: dict = field(default_factory=dict)


def load(path: str | Path) -> Config:
    """Unknown settings are errors."""
    raw = load_raw(path)
    raw = interpolate(raw, {k: v for k, v in raw.get("options", {}).items() if isinstance(v, str | int)})
    known = {f.name for f in fields(Config)}
    if extra := set(raw) - known:
        raise TypeError(f"unknown settings: {sorted(extra)}")
    data = Data(**raw.pop("data", {}))
    if not 0 <= data.validation_ratio < 1:
        raise ValueError("validation_ratio must be at least 0 and below 1")
    return Config(data=data, **raw)


def task_of(path: str | Path, task: str | None = None, allowed: tuple[str, ...] = ("parsing",)) -> str:
    """The given task, or the one that the name of a configuration file says."""
    stem = Path(path).stem.casefold()
    found = str(task).strip().casefold() if task is not None else next((t for t in allowed if t in stem), None)
    if found not in allowed:
        raise ValueError(f"{path}: no task of {list(allowed)} is given or named")
    return found


def ensure_distinct(a: str, b: str) -> None:
    if Path(a).resolve() == Path(b).resolve():
        raise ValueError("prediction and reference must be different files")


def same_contract(a: dict, b: dict, keys: tuple[str, ...]) -> list[str]:
    """Settings, by dotted key, in which two runs differ."""

    def at(d, key):
        for part in key.split("."):
            d = d.get(part) if isinstance(d, dict) else None
        return d

    return [k for k in keys if at(a, k) != at(b, k)]


def training_problems(training: dict, student: dict | None = None) -> list[str]:
    """What is wrong with the settings of a training run, all of it; settings that are left out have their defaults."""
    t = {"validation_every_epochs": 1, "early_stopping_patience": 1, "early_stopping_min_delta": 0.0} | {k: v for k, v in training.items() if v is not None}
    s, out = student or {}, []
    rate = t.get("projector_learning_rate")
    out += [f"{k} must be positive" for k in ("validation_every_epochs", "early_stopping_patience") if t[k] <= 0]
    if t["early_stopping_min_delta"] < 0:
        out.append("early_stopping_min_delta must not be negative")
    if rate is not None and rate <= 0:
        out.append("projector_learning_rate must be positive")
    if rate is not None and (not s.get("train_multimodal_projector") or s.get("use_projector_lora")):
        out.append("projector_learning_rate needs a projector that is trained as a whole")
    if t.get("early_stopping_enabled") and not t.get("validation_enabled"):
        out.append("early stopping needs validation")
    if t.get("validation_enabled"):
        if not 0 < t.get("validation_ratio", 0) < 1:
            out.append("validation needs a validation_ratio between 0 and 1")
        if not t.get("validation_label_path"):
            out.append("validation needs a validation_label_path")
    return out

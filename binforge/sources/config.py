"""Analysis configuration: small JSON and YAML files, read on the driver into plain dataclasses.

Missing or broken files give defaults and a warning, never an error, and no configuration is executed as code.
"""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from binforge.functions.binning import limits
from binforge.operators.fill import Pair
from binforge.operators.selection import CUTS

log = logging.getLogger(__name__)

#: Weights of the even and the odd hypothesis.
CP_WEIGHTS = ("wt_cp_sm", "wt_cp_ps")


def load_json(path: str | Path, default: Any = None) -> Any:
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        log.warning("%s: %s", path, e)
        return {} if default is None else default


def load_yaml(path: str | Path, default: Any = None) -> Any:
    try:
        import yaml
    except ImportError:
        yaml = None
    try:
        text = Path(path).read_text()
        found = yaml.safe_load(text) if yaml else json.loads(text)  # JSON is YAML too
        return {} if found is None else found
    except (OSError, ValueError) as e:
        log.warning("%s: %s", path, e)
    except Exception as e:  # yaml's own errors share no base with ValueError
        if yaml is None or not isinstance(e, yaml.YAMLError):
            raise
        log.warning("%s: %s", path, e)
    return {} if default is None else default


def save_json(found: Any, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(found, indent=2) + "\n")


@dataclass(frozen=True)
class Sample:
    name: str
    kind: str = "mc"
    scale: float = 1.0
    color: str | None = None
    files: tuple[str, ...] = ()
    dirs: tuple[str, ...] = ()
    params_key: str | None = None


@dataclass(frozen=True)
class Process:
    name: str
    samples: tuple[str, ...]
    color: str | None = None
    label: str | None = None


@dataclass(frozen=True)
class Asymmetry:
    column: str
    bins: int
    range: tuple[float, float]
    weights: tuple[str | None, str | None] = (None, None)


@dataclass(frozen=True)
class Config:
    samples: tuple[Sample, ...] = ()
    processes: tuple[Process, ...] = ()
    params: dict[str, dict[str, float]] = field(default_factory=dict)
    lumi: float = 1.0
    variables: dict[str, dict] = field(default_factory=dict)
    control: tuple[str, ...] = ()
    pairs: tuple[Pair, ...] = ()
    selection: dict[str, float] = field(default_factory=dict)
    runtime: dict[str, Any] = field(default_factory=dict)
    asymmetry: Asymmetry | None = None
    qcd: bool = True
    fake_factor: float = 1.0
    #: False leaves rows of CSV files uncut.
    csv_apply_selection: bool = True
    root: str = "."


def _list(x: Any) -> tuple[str, ...]:
    return () if x is None else (x,) if isinstance(x, str) else tuple(map(str, x))


def samples_of(found: dict) -> tuple[Sample, ...]:
    """From {sample: cfg} or {"samples": {sample: cfg}}."""
    found = found.get("samples", found)
    return tuple(
        Sample(name, str(c.get("kind", "mc")), float(c.get("scale", 1.0)), c.get("color"), _list(c.get("files")), _list(c.get("dirs")), c.get("params_key"))
        for name, c in found.items() if isinstance(c, dict) and name != "process"
    )


def processes_of(found: dict) -> tuple[Process, ...]:
    """From {process: {samples, color, label}} or {process: [samples]}, in order."""
    return tuple(Process(name, _list(c)) if not isinstance(c, dict) else Process(name, _list(c.get("samples")), c.get("color"), c.get("label")) for name, c in found.items())


def pairs_of(found: Any, variables: dict[str, dict], wrap: str = "all") -> tuple[Pair, ...]:
    """Items of two names, true and reconstructed, with the settings of the second; others are skipped with a warning."""
    out = []
    for item in found or []:
        if not isinstance(item, (list, tuple)) or len(item) != 2:
            log.warning("not a pair of columns: %r", item)
            continue
        own = variables.get(str(item[1]), {})
        out.append(Pair(str(item[0]), str(item[1]), own.get("type") == "angle", bool(own.get("relative_resolution", True)), wrap != "angle_only"))
    return tuple(out)


def load(folder: str | Path, fallback: str | Path | None = None, root: str | Path = ".") -> Config:
    """files.json, process.json, params.yaml, variables.json, plotter.yaml and selection.yaml of one folder.

    plotter.yaml may hold add_qcd_from_ss and qcd_ff (the factor from SS to OS), and under plotter_runtime
    csv_apply_selection (false leaves CSV files uncut) and wrap ("angle_only" leaves other differences unwrapped).

    A file that the folder lacks is looked for in ``fallback``.
    """
    def path(name: str) -> Path:
        own = Path(folder) / name
        return own if own.exists() or fallback is None else Path(fallback) / name

    params = load_yaml(path("params.yaml"))
    estimate = lambda key, default: main.get(key, plotting.get(key, runtime.get(key, default)))
    variables = load_json(path("variables.json"))
    main = load_yaml(path("plotter.yaml"))
    plotting, runtime = main.get("plotting") or {}, dict(main.get("plotter_runtime") or {})
    extra = (main.get("extra_plots") or runtime.get("extra_plots") or {}).get("asymmetry") or {}
    asymmetry = None
    if extra.get("enable", bool(extra)) and extra.get("column"):
        weights = extra.get("cp_weights", True)
        weights = CP_WEIGHTS if weights is True else ((*_list(weights or ()), None, None))[:2]
        asymmetry = Asymmetry(extra["column"], int(extra.get("bins", 20)), limits(extra.get("range", [0, 1])), weights)
    cuts = load_yaml(path("selection.yaml")) if path("selection.yaml").exists() else {}
    for k in cuts.keys() - CUTS.keys():
        log.warning("unknown cut %s", k)
    return Config(
        samples_of(load_json(path("files.json"))), processes_of(load_json(path("process.json"))), {k: v for k, v in params.items() if isinstance(v, dict)}, float(params.get("lumi", 1.0)), variables,
        _list(plotting.get("control")), pairs_of(plotting.get("resolution"), variables, str(runtime.get("wrap", "all"))), {k: float(v) for k, v in cuts.items() if k in CUTS and v is not None}, runtime, asymmetry,
        bool(estimate("add_qcd_from_ss", True)), float(estimate("qcd_ff", 1.0)), bool(runtime.get("csv_apply_selection", True)), root=str(root),
    )

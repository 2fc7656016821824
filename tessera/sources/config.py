"""The declarative request of a structure: reading, rules over its fields, and digests."""

from __future__ import annotations

import hashlib
import json
from typing import Any

GEOMETRIES = ("flat", "curved", "voxel_import")
METHODS = ("additive", "anisotropic", "warp", "perturbed_distance")


def load(path: str) -> dict[str, Any]:
    """A mapping from JSON, or YAML where a reader for it is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml package; use JSON") from e
        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: not a mapping")
    return found


def digest(config: dict[str, Any]) -> str:
    """Of the content, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _at(c: dict[str, Any], path: str, default: Any = None) -> Any:
    for k in path.split("."):
        if not isinstance(c, dict) or k not in c:
            return default
        c = c[k]
    return c


def check(c: dict[str, Any]) -> list[tuple[str, str, str]]:
    """(rule, severity, message) of all rules that a request breaks; an empty list passes gate G1."""
    bad: list[tuple[str, str, str]] = []

    def need(ok: bool, rule: str, message: str, severity: str = "error") -> None:
        if not ok:
            bad.append((rule, severity, message))

    n, geometry, method = _at(c, "grains.number"), _at(c, "grains.geometry", "flat"), _at(c, "grains.curved.method")
    crystals = [c["crystal"]] if "crystal" in c else [p.get("crystal", {}) for p in c.get("phases", [])]
    cubic = all(195 <= (x.get("space_group") or 0) <= 230 for x in crystals) if crystals else False
    periodic = _at(c, "box.periodic", [True, True, True])
    orientation = _at(c, "orientation.mode", "random")
    need(_at(c, "seed.mode", "fixed") != "fixed" or _at(c, "seed.value") is not None, "1", "a fixed seed needs a value")
    need(geometry == "voxel_import" or (isinstance(n, int) and n > 0), "16", "the number of grains is needed")
    need(("crystal" in c) != ("phases" in c), "21", "give either a crystal or phases")
    need(_at(c, "box.vacuum", 0) <= 0 or not all(periodic), "2", "a vacuum needs an axis that is not periodic")
    need(orientation != "from_list" or len(_at(c, "orientation.list", [])) == n, "3", "one orientation for each grain")
    for x in crystals:
        need(not ("cif" in x and any(k in x for k in ("space_group", "lattice", "sites"))), "27", "a file of the crystal excludes its manual fields")
        for s in x.get("sites", []):
            o = s.get("occupancy", {s.get("species", "X"): 1.0})
            need(all(v > 0 for v in o.values()) and abs(sum(o.values()) - 1) <= 1e-6, "5b", "occupancies are positive and sum to 1")
    need(("lengths" in c.get("box", {})) != ("cells" in c.get("box", {})), "28", "give the box by lengths or by cells")
    need(not _at(c, "analysis.csl", False) or cubic, "4", "coincidence labels need cubic crystals")
    need(not (_at(c, "analysis.gb_curvature", False) and geometry == "voxel_import"), "25", "curvature needs a smooth margin")
    need(geometry in GEOMETRIES, "geometry", f"one of {', '.join(GEOMETRIES)}")
    need(not (geometry == "flat" and _at(c, "grains.curved") is not None), "6", "a flat geometry takes no curved block")
    need(geometry != "curved" or method in METHODS, "method", f"one of {', '.join(METHODS)}")
    need(not (method == "warp" and _at(c, "grains.curved.spectrum") == "self_affine"), "8a", "a warp cannot be self-affine")
    rms, clip = _at(c, "grains.curved.amplitude_rms"), _at(c, "grains.curved.amplitude_clip")
    need(rms is None or clip is None or rms <= clip, "7", "the amplitude is at most its clip")
    wave = _at(c, "grains.curved.correlation_length")
    need(not (method == "warp" and rms and wave) or rms / wave < 0.5, "8", "the warp may fold over", "warning")
    target = _at(c, "grains.volumes.mode")
    need(target is None or geometry == "flat" or _at(c, "grains.curved.base") == "power", "10", "target volumes need weighted cells")
    need(target != "list" or len(_at(c, "grains.volumes.list", [])) == n, "11", "one target volume for each grain")
    need(_at(c, "grains.curved.base") != "power" or target is not None, "12", "a weighted base needs target volumes")
    parts = _at(c, "orientation.components", [])
    need(orientation != "odf_components" or (parts and all(p.get("weight", 0) > 0 for p in parts)), "13", "components have positive weights")
    bins = _at(c, "mdf.target.histogram")
    need(bins is None or (len(bins) > 0 and all(v >= 0 for v in bins) and sum(bins) > 0), "14", "a target histogram has mass and no negative bin")
    need(_at(c, "mdf.target.sigma3") is None or cubic, "15", "twin targets need cubic crystals")
    need(geometry != "voxel_import" or _at(c, "grains.import.file") is not None, "17", "an import needs its file")
    need(not str(_at(c, "grains.import.file", "")).endswith((".h5", ".hdf5", ".dream3d")) or _at(c, "grains.import.dataset") is not None, "17b", "an HDF5 file needs the path of its data")
    need(not (geometry == "voxel_import" and any(_at(c, f"grains.{k}") is not None for k in ("min_distance", "lloyd"))), "18", "seeding is left out for an import", "warning")
    need(orientation != "imported" or (geometry == "voxel_import" and _at(c, "grains.import.eulers") is not None), "19", "imported orientations need an import with angles")
    phases = c.get("phases", [])
    need(len(phases) < 2 or not (_at(c, "analysis.csl", False) or _at(c, "mdf.target") is not None), "22", "one point group is needed for coincidence labels and targets")
    need(not phases or not isinstance(n, int) or n >= len(phases), "23", "fewer grains than phases")
    need(not phases or abs(sum(p.get("fraction", 0) for p in phases) - 1) <= 1e-6, "fractions", "phase fractions sum to 1")
    need(n != 1 or geometry == "flat", "24", "a single grain is flat")
    need(not (c.get("doping") and len(phases) > 1), "26", "doping needs one phase")
    for d in c.get("doping", []):
        need(0 < d.get("fraction", 0) < 1, "26b", "a dopant's share is between 0 and 1")
    return bad


def validated(c: dict[str, Any]) -> dict[str, Any]:
    """The request, if no rule of severity error is broken."""
    if errors := [f"rule {r}: {m}" for r, s, m in check(c) if s == "error"]:
        raise ValueError("; ".join(errors))
    return c

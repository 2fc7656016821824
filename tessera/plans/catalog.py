"""All queries of the engine and their SQL."""

from . import crystals, orientations, polyhedra, textures  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401

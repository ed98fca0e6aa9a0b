"""Run parameters and how they are resolved."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum, IntEnum


class Missing(IntEnum):
    """What a missing allele means."""

    PAIR_DELETE = 0
    COMPLETE_DELETE = 1
    AS_ALLELE = 2
    ABSOLUTE_DISTANCE = 3


class Matrix(str, Enum):
    SYMMETRIC = "symmetric"
    ASYMMETRIC = "asymmetric"
    BLOCKWISE = "blockwise"
    #: Not reached by resolve(); for callers of the distance operator.
    ASYMMETRIC_WGMLST = "asymmetric_wgMLST"


class Heuristic(str, Enum):
    HARMONIC = "harmonic"
    EBURST = "eBurst"


class Method(str, Enum):
    MSTREE_V2 = "MSTreeV2"
    MSTREE = "MSTree"
    NJ = "NJ"
    RAPID_NJ = "RapidNJ"
    NINJA = "ninja"
    DISTANCE = "distance"


@dataclass(frozen=True)
class Params:
    method: Method = Method.MSTREE_V2
    matrix: Matrix = Matrix.SYMMETRIC
    missing: Missing = Missing.PAIR_DELETE
    heuristic: Heuristic = Heuristic.EBURST
    recraft: bool = False
    recraft_mode: str = "compat"
    native: bool = False
    block_penalty: float = 0.5

    @staticmethod
    def of(**given) -> Params:
        """Parameters from names or members; an unknown one raises ValueError."""
        kinds = {"method": Method, "matrix": Matrix, "missing": Missing, "heuristic": Heuristic}
        return Params(**{k: kinds[k](v) if k in kinds else v for k, v in given.items()})

    def resolved(self) -> Params:
        """The default method is a spanning arborescence over asymmetric distances
        with harmonic weights and recraft; block-wise matrices have neither."""
        out = self
        if out.matrix is Matrix.BLOCKWISE:
            out = replace(out, recraft=False, method=Method.MSTREE if out.method is Method.MSTREE_V2 else out.method)
        if out.method is Method.MSTREE_V2:
            out = replace(out, method=Method.MSTREE, matrix=Matrix.ASYMMETRIC, heuristic=Heuristic.HARMONIC, recraft=True)
        return out

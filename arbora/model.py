"""Schemas and settings (inventory D1-D18)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

FINGERPRINT = T.StructType([T.StructField("weight", T.LongType()), T.StructField("digest", T.StringType())])
BAG = T.ArrayType(FINGERPRINT)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
UNITS = _schema(key=_S, source=_S, text=_S, ord=_L)
TREES = _schema(tree_id=_S, name=_S, source=_S, loc_start=_I, loc_end=_I, ir=_S)
NODES = _schema(tree_id=_S, node_id=_I, parent_id=_I, ord=_I, role=_S, kind=_S, payload=_S, case_key=_S)
FINGERPRINTS = _schema(label=_S, weight=_L, digest=_S, subs=BAG)
CLASSES = _schema(weight=_L, digest=_S, labels=T.ArrayType(_S))
EDGES = _schema(x=_S, y=_S, dist=_L)  # x < y; a missing row is an infinite distance
COMPONENTS = _schema(node=_S, component=_S)
MERGES = _schema(component=_S, node_id=_S, left_id=_S, right_id=_S, height=_L, n_leaves=_L)
REJECTED = _schema(key=_S, reason=_S)

#: Written next to a stored data set, so that one kind can't be read as the other.
KIND_CLASSES, KIND_FOREST = "classes", "forest"


@dataclass(frozen=True)
class Config:
    """should_sort: commutative hashing; hash_var: identifiers count."""

    should_sort: bool = False
    hash_var: bool = True


STRICT, LOOSE = Config(False, True), Config(True, False)


@dataclass(frozen=True)
class Threshold:
    """Which sub-trees a bag keeps: weight strictly above `value`, or above `value` percent of the main weight."""

    value: int
    percent: bool = False

    def keeps(self, weight: int, main_weight: int) -> bool:
        return weight > (self.value / 100.0) * main_weight if self.percent else weight > self.value


def hard(value: int) -> Threshold:
    return Threshold(value)


def percent(value: int) -> Threshold:
    return Threshold(value, True)

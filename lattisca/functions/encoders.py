"""Encoders: attribute values to arrays of floats, as column expressions. Each has ``encode`` and the value of ``default``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattisca.operators.edges import LABELS


def _lookup(mapping: dict[str, int], value: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]), value)


class Encoder:
    width = 1

    def encode(self, value: Column) -> Column:
        """An array of ``width`` floats; what cannot be encoded gives the default."""
        raise NotImplementedError


@dataclass
class OneHotEncoder(Encoder):
    """Unknown values are all zeros."""

    mapping: dict[str, int]

    @property
    def width(self) -> int:
        return max(self.mapping.values()) + 1 if 0 in self.mapping.values() else max(self.mapping.values())

    def encode(self, value: Column) -> Column:
        at = _lookup(self.mapping, value)
        return F.array(*[F.when(at == i, 1.0).otherwise(0.0).cast("float") for i in range(self.width)])


@dataclass
class MultiHotEncoder(OneHotEncoder):
    """Values are arrays of labels."""

    def encode(self, value: Column) -> Column:
        names = {v: k for k, v in self.mapping.items()}
        return F.array(*[F.when(F.array_contains(value, names[i]), 1.0).otherwise(0.0).cast("float") if i in names else F.lit(0.0).cast("float") for i in range(self.width)])


@dataclass
class IntMappingEncoder(Encoder):
    mapping: dict[str, int]
    default: int = 0

    def encode(self, value: Column) -> Column:
        return F.array(F.coalesce(_lookup(self.mapping, value), F.lit(self.default)).cast("float"))


@dataclass
class IntEncoder(Encoder):
    default: int = 0

    def encode(self, value: Column) -> Column:
        return F.array(F.coalesce(value.try_cast("int"), F.lit(self.default)).cast("float"))


@dataclass
class FloatEncoder(Encoder):
    default: float = 0.0

    def encode(self, value: Column) -> Column:
        return F.array(F.coalesce(value.try_cast("double"), F.lit(self.default)).cast("float"))


@dataclass
class BoolEncoder(Encoder):
    """Null gives the default; numbers are true unless zero; what is no number is true."""

    default: bool = False

    def encode(self, value: Column) -> Column:
        text = value.cast("string")
        number = text.try_cast("double")
        truth = F.when(text.isNull(), F.lit(self.default)).when(F.lower(text) == "false", False).when(number.isNotNull(), number != 0).otherwise(True)
        return F.array(truth.cast("float"))


@dataclass
class ListEncoder(Encoder):
    """A null list, or one with a null, is all zeros."""

    length: int

    @property
    def width(self) -> int:
        return self.length

    def encode(self, value: Column) -> Column:
        bad = value.isNull() | F.exists(value, lambda x: x.isNull())
        return F.when(bad, F.array_repeat(F.lit(0.0).cast("float"), self.length)).otherwise(F.transform(value, lambda x: x.cast("float")))


@dataclass
class SymbolEncoder(Encoder):
    """Letters to codes, whatever their case; others are 0."""

    letters: str = "ACGU"

    def encode(self, value: Column) -> Column:
        return F.array(self.code(value).cast("float"))

    def code(self, value: Column) -> Column:
        return _lookup({c: i + 1 for i, c in enumerate(self.letters)}, F.upper(value)) if self.letters else F.lit(0)

    def decode(self, code: Column) -> Column:
        return F.coalesce(F.get(F.array(*[F.lit(c) for c in self.letters]), code - 1), F.lit("X"))


#: Known residue attributes and how they are encoded; None: known, but not encoded.
NODE_FEATURES: dict[str, Encoder | None] = {
    "nt_code": OneHotEncoder({"A": 0, "U": 1, "C": 2, "G": 3, "a": 0, "u": 1, "c": 2, "g": 3}),
    "is_modified": BoolEncoder(),
    "protein_binding": BoolEncoder(),
    "index": IntEncoder(),
    "nt_resnum": IntEncoder(),
    "chi": FloatEncoder(),
    "eta": FloatEncoder(),
    "theta": FloatEncoder(),
    "xyz_P": ListEncoder(3),
    "frame_quaternion": ListEncoder(4),
    "chain_id": None,
    "nt_full": None,
}


#: Known edge attributes.
EDGE_FEATURES: dict[str, Encoder] = {"label": OneHotEncoder({label: i for i, label in enumerate(LABELS)})}


@dataclass
class FeaturesComputer:
    """Columns ``features`` and ``targets``: the encodings of named attributes, one behind the other."""

    features: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    custom: dict[str, Encoder] = field(default_factory=dict)

    def parser(self, names: list[str]) -> dict[str, Encoder]:
        """Own encoders go before the registry's; attributes that are known but not encoded are left out."""
        out = {}
        for name in names:
            if name not in self.custom and name not in NODE_FEATURES:
                raise ValueError(f"{name} has no encoder")
            encoder = self.custom.get(name, NODE_FEATURES.get(name))
            if encoder is not None:
                out[name] = encoder
        return out

    def add_feature(self, name: str, encoder: Encoder | None = None, is_input: bool = True) -> None:
        if encoder is not None:
            self.custom[name] = encoder
        (self.features if is_input else self.targets).append(name)

    def remove_feature(self, name: str, is_input: bool = True) -> None:
        (self.features if is_input else self.targets).remove(name)

    @property
    def input_dim(self) -> int:
        return sum(e.width for e in self.parser(self.features).values())

    @property
    def output_dim(self) -> int:
        return sum(e.width for e in self.parser(self.targets).values())

    def compute(self, nodes: DataFrame) -> DataFrame:
        out = nodes
        for column, names in (("features", self.features), ("targets", self.targets)):
            parts = [e.encode(F.col(n)) for n, e in self.parser(names).items()]
            if parts:
                out = out.withColumn(column, F.concat(*parts))
        return out

    def compute_edges(self, edges: DataFrame, names: tuple[str, ...] = ("label",)) -> DataFrame:
        """Edges with ``features``: the encodings of their attributes, own encoders before the registry's."""
        some = [self.custom.get(n, EDGE_FEATURES.get(n)) for n in names]
        if None in some:
            raise ValueError(f"{names[some.index(None)]} has no encoder")
        return edges.withColumn("features", F.concat(*[e.encode(F.col(n)) for e, n in zip(some, names, strict=True)]))

    def without_others(self, nodes: DataFrame, keep: list[str]) -> DataFrame:
        return nodes.select(*dict.fromkeys([*keep, *self.features, *self.targets]))


def mean_fill(nodes: DataFrame, column: str, width: int) -> DataFrame:
    """Null vectors become their graph's mean, element by element; zeros where a graph has none."""
    means = nodes.groupBy("graph").agg(F.array(*[F.avg(F.get(F.col(column), i)) for i in range(width)]).alias("_mean"))
    filled = F.coalesce(F.col(column).cast("array<double>"), F.transform("_mean", lambda x: F.coalesce(x, F.lit(0.0))))
    return nodes.join(means, "graph").withColumn(column, filled).drop("_mean")

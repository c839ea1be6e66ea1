"""The trace model: head columns, closed vocabularies, time units and argument roles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the trace format: layer codes; 128 to 255 belong to extensions.
LAYERS = {
    0: "UNKNOWN", 1: "INTERNAL", 2: "C_APP", 3: "POSIX", 4: "HIP", 5: "HDF5", 6: "PYTHON", 7: "PSUTIL", 8: "FINSTRUMENT",
    9: "CPP_APP", 10: "MPI", 11: "PAPI", 12: "OMNISTAT", 13: "VARIORUM", 14: "CUDA",
}
#: Phase codes, and the letters that older traces and the viewer's format use.
PHASES = {1: "COMPLETE", 2: "COUNTER", 3: "AGGREGATED", 4: "METADATA"}
PHASE_LETTERS = {1: "X", 2: "C", 3: "C", 4: "M"}
#: Units of ts and dur in nanoseconds.
UNIT_NS = {"NS": 1, "US": 1_000, "MS": 1_000_000, "SEC": 1_000_000_000}
#: Layers that are never folded into aggregates.
NEVER_AGGREGATED = (1, 7, 11, 12, 13)

HEAD = "id bigint, name string, cat string, type smallint, ph smallint, pid bigint, tid bigint, ts bigint, dur bigint"


def code_map(names: dict[int, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))


def layer_name(code: Column, extra: dict[int, str] | None = None) -> Column:
    """A layer's name; unknown codes degrade to UNKNOWN, those of extensions to EXTERNAL."""
    known = code_map(LAYERS | (extra or {}))
    return F.coalesce(F.try_element_at(known, code.cast("int")), F.when(code >= 128, "EXTERNAL").otherwise("UNKNOWN"))


def layer_set(mask: Column) -> Column:
    """The names of the layers whose bits a process's mask of used layers has set, in the order of codes."""
    return F.transform(F.filter(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(n).alias("n")) for c, n in sorted(LAYERS.items()))), lambda x: F.call_function("getbit", mask, x["c"]) == 1), lambda x: x["n"])


def layer_mask(code: Column) -> Column:
    """The bit of a layer, to be joined by bit_or."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), code.cast("int"))


def used_names(used: Column) -> Column:
    """The names in the JSON of an end record's `used`, e.g. {"MPI":1,"torch":1}: layers and what extensions have reported; sorted."""
    entries = F.map_entries(F.from_json(used, "map<string,int>"))
    return F.array_sort(F.transform(F.filter(entries, lambda e: e["value"] > 0), lambda e: e["key"]))


def phase_letter(code: Column) -> Column:
    return F.coalesce(F.try_element_at(code_map(PHASE_LETTERS), code.cast("int")), F.lit("X"))


def phase_code(letter: Column) -> Column:
    """The code of a phase given as a code or as a letter."""
    coded = F.create_map(*(F.lit(x) for pair in {"X": 1, "C": 2, "A": 3, "M": 4}.items() for x in pair))
    return F.coalesce(F.try_element_at(coded, letter), letter.try_cast("int")).cast("smallint")


def to_unit(value: Column, unit: str, wanted: str) -> Column:
    """Converts times between units, rounding down."""
    up, down = UNIT_NS[unit], UNIT_NS[wanted]
    return value * (up // down) if up >= down else F.floor(value / (down // up)).cast("bigint")


@dataclass(frozen=True)
class ArgRoles:
    """What an argument is to aggregation: part of the key, a folded value, or neither."""

    keys: frozenset[str] = field(default_factory=lambda: frozenset({"fhash"}))
    values: frozenset[str] = field(default_factory=lambda: frozenset({"ret", "size", "count", "offset", "whence", "mode", "flags", "length"}))
    strict: bool = False

    def is_key(self, key: Column, is_number: Column) -> Column:
        named, folded = key.isin(*self.keys), key.isin(*self.values)
        return named | (~folded if self.strict else (~folded & ~is_number))

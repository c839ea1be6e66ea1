"""Checks of nested file-system records: mounts, directories and files as structs, with capacities and layouts of parallel file systems inside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelathe.operators.written import written

#: Fixed values of the trace format: the columns of each level's own hash, and the numbers in a mount's capacity.
OWN_HASH = {"mount": "mhash", "dir": "dhash", "file": "fhash"}
CAPACITY = ("total_bytes", "free_bytes", "avail_bytes", "total_inodes", "free_inodes")
_COMPONENT = "start: string, end: string, stripe_count: bigint, stripe_size: bigint, osts: array<bigint>"
RECORD = (
    "level string, mhash string, dhash string, fhash string, fs string, bsize bigint, namelen bigint, read_only int, rotational int, size bigint, blksize bigint, "
    f"capacity struct<{', '.join(f'{c}: bigint' for c in CAPACITY)}>, "
    f"lustre struct<liblustreapi: int, mdt: bigint, stripe_count: bigint, stripe_size: bigint, osts: array<bigint>, components: array<struct<{_COMPONENT}>>>"
)


def parse_records(records: DataFrame, args: str = "args", keys: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Keys and the fields of RECORD from the JSON text of file-system records; fields of another type are null."""
    return records.select(*keys, F.from_json(args, RECORD).alias("r")).select(*keys, "r.*")


def _bad_osts(osts: Column) -> Column:
    """Not a list of indices, each once, in order."""
    good = F.forall(osts, lambda o: o.isNotNull() & (o >= 0)) & (osts == F.array_sort(F.array_distinct(osts)))
    return ~F.coalesce(good, F.lit(False))


def _said(problem: str, when: Column) -> Column:
    return F.when(when, F.lit(problem))


def _bad(value: Column, least: int) -> Column:
    return F.coalesce(value < least, F.lit(True))


def layout_problems(lustre: Column) -> Column:
    """Array of what is wrong with a file's layout: stripe settings at its top or in each component, and the components' targets as their union."""
    parts = lustre["components"]
    plain = parts.isNull()
    union = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda c: F.coalesce(c["osts"], F.array().cast("array<bigint>"))))))
    missing = lambda c: reduce(lambda a, b: a | b, (c[k].isNull() for k in ("start", "end", "stripe_count", "stripe_size", "osts")))
    found = F.array(
        _said("stripe_count", plain & _bad(lustre["stripe_count"], -1)), _said("stripe_size", plain & _bad(lustre["stripe_size"], -1)),
        _said("osts", _bad_osts(lustre["osts"])), _said("component fields", F.exists(parts, missing)),
        _said("component osts", F.exists(parts, lambda c: _bad_osts(c["osts"]))), _said("osts are not the components'", ~plain & ~F.coalesce(union == F.array_sort(F.array_distinct(lustre["osts"])), F.lit(False))),
    )
    return F.filter(found, lambda x: x.isNotNull())


def problems(records: DataFrame, names: DataFrame, keys: tuple[str, ...] = ("pid",)) -> DataFrame:
    """(keys, level, id, problem): every fault of parsed records; names: `value`, the hashes that have a name.

    Levels join their parents by the process's keys and hash, each an equi-join; all other rules are conditions on a record's structs and arrays.
    """
    keys = list(keys)
    own = F.coalesce(*(F.when(F.col("level") == level, F.col(c)) for level, c in OWN_HASH.items()))
    rows = written(records.withColumn("id", own))
    none = F.lit(None).cast("string").alias("id")
    wrong = rows.filter(~F.coalesce(F.col("level").isin(*OWN_HASH), F.lit(False))).select(*keys, "level", none, F.lit("level").alias("problem"))
    known = rows.filter(F.col("level").isin(*OWN_HASH))
    unnamed = known.join(names.select(F.col("value").alias("id")).distinct(), "id", "left_anti").select(*keys, "level", "id", F.lit("unknown hash").alias("problem"))
    twice = known.filter("id is not null").groupBy(*keys, "level", "id").count().filter("count > 1").select(*keys, "level", "id", F.lit("described twice").alias("problem"))
    levels = known.groupBy(*keys).agg(F.count_if(F.col("level") == "mount").alias("m"), F.count_if(F.col("level") == "dir").alias("d"))
    lacking = levels.select(*keys, F.explode(F.filter(F.array(F.when(F.col("m") == 0, F.lit("mount")), F.when(F.col("d") == 0, F.lit("dir"))), lambda x: x.isNotNull())).alias("level")).select(*keys, "level", none, F.lit("no record").alias("problem"))

    mount, capacity, lustre = known.filter("level = 'mount'"), F.col("capacity"), F.col("lustre")
    flag = lambda c: ~F.coalesce(c.isin(0, 1), F.lit(False))
    of_mount = F.array(
        _said("fs", F.coalesce(F.col("fs") == "", F.lit(True))), _said("bsize", _bad(F.col("bsize"), 1)), _said("namelen", _bad(F.col("namelen"), 1)),
        *(_said(f"capacity.{c}", _bad(capacity[c], 0)) for c in CAPACITY), _said("read_only", flag(F.col("read_only"))),
        _said("rotational", F.col("rotational").isNotNull() & flag(F.col("rotational"))), _said("lustre on another file system", lustre.isNotNull() & ~F.col("fs").eqNullSafe("lustre")),
        _said("liblustreapi", lustre.isNotNull() & flag(lustre["liblustreapi"])), _said("no lustre", lustre.isNull() & F.col("fs").eqNullSafe("lustre")),
    )

    # A record that stands twice counts once as a parent, as Lustre if it is so anywhere.
    mounts = mount.groupBy(*keys, F.col("id").alias("mhash")).agg(F.max(F.coalesce(lustre["liblustreapi"] == 1, F.lit(False))).alias("lustre_mount"))
    dirs = known.filter("level = 'dir'").join(mounts, [*keys, "mhash"], "left")
    of_dir = F.array(
        _said("no mount record", F.col("lustre_mount").isNull()), _said("lustre on another mount", lustre.isNotNull() & ~F.coalesce("lustre_mount", F.lit(False))),
        _said("mdt", lustre.isNotNull() & lustre["mdt"].isNull()),
    )
    parents = dirs.groupBy(*keys, F.col("id").alias("dhash")).agg(F.max(lustre.isNotNull() & F.coalesce("lustre_mount", F.lit(False))).alias("lustre_dir"))
    files = known.filter("level = 'file'").join(parents, [*keys, "dhash"], "left")
    of_file = F.concat(
        F.array(
            _said("no dir record", F.col("lustre_dir").isNull()), _said("size", _bad(F.col("size"), 0)), _said("blksize", _bad(F.col("blksize"), 0)),
            _said("lustre in another dir", lustre.isNotNull() & ~F.coalesce("lustre_dir", F.lit(False))),
        ),
        F.when(lustre.isNotNull(), layout_problems(lustre)).otherwise(F.array().cast("array<string>")),
    )
    said = [part.select(*keys, "level", "id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem")) for part, found in ((mount, of_mount), (dirs, of_dir), (files, of_file))]
    return reduce(DataFrame.union, [wrong, unnamed, twice, lacking, *said])

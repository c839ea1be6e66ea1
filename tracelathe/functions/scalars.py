"""Scalar functions, all of built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash16(text: Column) -> Column:
    """The 16 hex digits of bytes 0, 2, ..., 14 of the MD5."""
    digest = F.md5(text.cast("binary"))
    return F.concat(*(F.substring(digest, 4 * k + 1, 2) for k in range(8)))


def fix_str(text: Column) -> Column:
    """Control characters and signs that break unescaped JSON become spaces."""
    return F.regexp_replace(text, r"""[\x00-\x1f\x7f()\\"'|]""", " ")


def strip_unprintable(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x20-\x7E\r\t]", "")


def anonymize(text: Column, user: str, by: str = "USER") -> Column:
    return F.replace(text, F.lit(user), F.lit(by))


def digits_to_x(text: Column) -> Column:
    return F.regexp_replace(text, r"[0-9]", "X")


def first_number(text: Column) -> Column:
    """The first run of digits as a number, null if there is none (host numbers)."""
    return F.nullif(F.regexp_extract(text, r"([0-9]+)", 1), F.lit("")).cast("bigint")


def interval_floor(ts: Column, width: int) -> Column:
    """The start of the tumbling interval that holds ts; also for negative times."""
    return (ts - F.pmod(ts, F.lit(width))).cast("bigint")


def interval_width(milliseconds: int, units_per_second: int) -> int:
    return max(1, milliseconds * units_per_second // 1000)


def _let(value: Column, of) -> Column:
    """of(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def human_size(value: Column) -> Column:
    """A size (below 10**31) in whole numbers of its unit, from three significant digits; NA for null and 0; bytes have no unit, and TB is the last one."""

    def rounded(digits: Column) -> Column:  # in millionths
        first, rest = F.coalesce(F.substring(digits, 1, 3).try_cast("int"), F.lit(0)), F.substring(digits, 4, 38)
        half = F.rpad(F.lit("5"), F.length(rest), F.lit("0"))
        up = (rest > half) | (rest == half) & (rest != "") & (first % 2 == 1)  # half to even, as the digits are cut off
        power = F.greatest(F.length(digits) - 3, F.lit(0)) - 6
        return F.concat((first + up.cast("int")).cast("string"), F.lit("E"), power.cast("string")).cast("double")

    def shown(size: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, unit in enumerate(("", "KB", "MB", "GB", "TB")):
            text = F.concat(F.rint(size / float(1024**k)).cast("bigint").cast("string"), F.lit(unit))
            out = text if not k else F.when(size >= 1024**k, text).otherwise(out)
        return out

    def text(v: Column) -> Column:
        digits = F.ltrim(F.replace(F.abs(v).cast("string"), F.lit("."), F.lit("")), F.lit("0"))
        size = _let(_let(digits, rounded), shown)
        return F.when(v.isNull() | (v == 0), "NA").otherwise(F.when((v < 0) & (size != "0"), F.concat(F.lit("-"), size)).otherwise(size))

    return _let(value.cast("decimal(38,6)"), text)


def hex_id(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def parent_dir(path: Column) -> Column:
    found = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(path.contains("/"), F.when(found == "", "/").otherwise(found))


def under(path: Column, point: Column) -> Column:
    """Whether a path is a directory or lies below it."""
    return (path == point) | (point == "/") & path.startswith("/") | path.startswith(F.concat(point, F.lit("/")))


def log_base(path: Column) -> Column:
    """A log file's path without its trace extension."""
    return F.regexp_replace(path, r"\.(pfw\.gz|pfw|gz)$", "")


def exec_name(command: Column, separator: str = "\0") -> Column:
    """The program of a command line, whose words end with a separator (NUL): the first base name that is no option and no interpreter.

    Base names that contain python, env or multiprocessing are passed over. Where nothing is left: DEFAULT-spawn if the last word's
    has multiprocessing in it, else DEFAULT.
    """
    words = F.split(command, f"[{separator}]")
    names = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.element_at(F.split(w, "/"), -1))
    own = F.filter(names, lambda n: ~n.startswith("-") & ~n.rlike("python|env|multiprocessing"))
    last = F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit(""))
    return F.when(command.isNotNull(), F.coalesce(F.try_element_at(own, F.lit(1)), F.when(last.contains("multiprocessing"), "DEFAULT-spawn").otherwise("DEFAULT")))


def pid_of_file(name: Column) -> Column:
    """The numeric second-last part between dashes of a trace file's name; else null."""
    part = F.try_element_at(F.split(F.element_at(F.split(name, "/"), -1), "-"), F.lit(-2))
    return F.when(part.rlike("^[0-9]+$"), part.try_cast("bigint"))


def split_list(text: Column) -> Column:
    """Parts between commas or semicolons, trimmed, the first of equal ones kept, empty ones dropped."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "[,;]"), lambda x: F.trim(x)), lambda x: x != ""))


def event_families(text: Column) -> Column:
    """FAM:ev,ev;FAM:... as an array of (family, events)."""
    parts = F.filter(F.split(text, ";"), lambda x: x.contains(":"))
    return F.transform(parts, lambda x: F.struct(F.trim(F.element_at(F.split(x, ":"), 1)).alias("family"), split_list(F.element_at(F.split(x, ":", 2), 2)).alias("events")))


def absolutize(path: Column, cwd: Column) -> Column:
    """A path made absolute by its text alone: . and .. are resolved, links are not."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(cwd, F.lit("/"), path))
    parts = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)),
    )
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def rebase(ns: Column, offset: int, unit: str) -> Column:
    """A device clock in nanoseconds in trace units plus an offset; without it where that isn't positive."""
    from tracelathe.schema import UNIT_NS

    own = F.floor(ns / UNIT_NS[unit]).cast("bigint")
    return F.when(own + offset > 0, own + offset).otherwise(own)


#: Names of file systems by the number that statfs gives.
FS_MAGIC = {
    0x0BD00BD0: "lustre", 0x47504653: "gpfs", 0x19830326: "beegfs", 0x00C36400: "ceph", 0x6969: "nfs", 0xEF53: "ext4", 0x58465342: "xfs",
    0x9123683E: "btrfs", 0x2FC12FC1: "zfs", 0x01021994: "tmpfs", 0x794C7630: "overlayfs", 0x73717368: "squashfs", 0x65735546: "fuse",
    0x9FA0: "proc", 0x62656572: "sysfs", 0x6E667364: "nfsd", 0xFF534D42: "cifs",
}


def fs_name(magic: Column) -> Column:
    """The name of a file system; unknown numbers as 0x and hex digits."""
    known = F.create_map(*(F.lit(x) for pair in FS_MAGIC.items() for x in pair))
    return F.coalesce(F.try_element_at(known, magic.cast("bigint")), F.concat(F.lit("0x"), F.lower(F.hex(magic.cast("bigint")))))


def percent_of(part: Column, total: Column) -> Column:
    """100 * part / total, with a total of 0 taken as 1."""
    return 100.0 * part / F.when(total == 0, 1).otherwise(total)

"""Paths, names and URLs as Column expressions; what bytes decide is a vectorised UDF."""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def percent_decode(s: pd.Series) -> pd.Series:
    """%XX decoded as UTF-8; what is no escape stays, "+" too."""
    return s.map(lambda x: x if x is None or "%" not in x else unquote_to_bytes(x).decode("utf-8", "replace"))


_UNSAFE = re.compile(rb"%(?![0-9A-Fa-f]{2})|[\x00-\x20\x7f-\xff\"<>\\^`{|}]")


@F.pandas_udf(T.StringType())
def percent_encode(s: pd.Series) -> pd.Series:
    """Bytes that a URL may not hold, and a lone "%", as %XX; valid escapes stay."""
    return s.map(lambda x: x if x is None else _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], x.encode()).decode("ascii"))


def normal_path(c: Column, keep_root: bool = False) -> Column:
    """Empty components go, ".." takes one away (never above the root), "." stays; a leading slash only if kept."""
    step = lambda a, x: F.when(x == "", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x))
    path = F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(c.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path) if keep_root else path


def folder(c: Column) -> Column:
    """What comes before the last slash ("/" for a file in the root, "" without a slash)."""
    return F.when(c.rlike("^/[^/]*$"), F.lit("/")).otherwise(F.regexp_extract(c, "^(.*)/[^/]*$", 1))


def safe_component(c: Column) -> Column:
    """A file name that FAT32 takes: reserved and control characters become "_", trailing dots and blanks go."""
    return F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1F]', "_"), r"[. ]+$", "")


def has_extension(c: Column, extension: str) -> Column:
    return F.lower(c).endswith(extension.lower())


def with_protocol(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("://")), c).otherwise(F.concat(F.lit("http://"), c))


def origin(c: Column) -> Column:
    """Scheme and host; without a scheme what comes before the first slash."""
    return F.when(F.contains(c, F.lit("://")), F.regexp_extract(c, "^.*?://[^/]*", 0)).otherwise(F.regexp_extract(c, "^[^/]*", 0))


def resolve(base: Column, ref: Column) -> Column:
    """A link of a page as an absolute URL; ".." is not resolved."""
    full = with_protocol(base)
    rest = F.concat(F.regexp_replace(F.regexp_replace(full, r"\?.*$", ""), "/+$", ""), F.lit("/"), ref)
    return percent_encode(F.when(F.contains(ref, F.lit("://")), ref).when(ref.startswith("/"), F.concat(origin(full), ref)).otherwise(rest))


def internal_link(c: Column) -> Column:
    return (c != "") & ~c.rlike("^(?:https?://|mailto:|ftp://|tel:|javascript:)")


def sampled_digest(text: Column, windows: int = 12) -> Column:
    """MD5 over windows of 1,024 characters at 0, 1,024, 4,096, 16,384 and so on."""
    at = [0, *(1024 * 4**i for i in range(windows - 1))]
    return F.md5(F.concat(*[F.substring(text, F.lit(a + 1), F.lit(1024)) for a in at]).cast("binary"))

"""Routing strings as Column expressions.  A string that can't be parsed gives null parts; valid() tells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SCHEME = "sns"


def _parts(scheme: Column, target: Column) -> Column:
    return F.struct(scheme.alias("scheme"), target.alias("target"))


def parse_uri(uri: Column) -> Column:
    """scheme://target, split at the first separator, which must not come first; the scheme in lower case."""
    at = F.position(F.lit("://"), uri)
    return F.when(at > 1, _parts(F.lower(F.substring(uri, F.lit(1), at - 1)), F.substring(uri, at + 3, F.char_length(uri))))


def parse_prefix(prefix: Column) -> Column:
    """A URI; or SCHEME|target, split at the first pipe; or a bare target of the default scheme."""
    pipe = F.position(F.lit("|"), prefix)
    piped = _parts(F.lower(F.substring(prefix, F.lit(1), pipe - 1)), F.substring(prefix, pipe + 1, F.char_length(prefix)))
    return F.when(F.position(F.lit("://"), prefix) > 0, parse_uri(prefix)).when(pipe > 0, piped).when(prefix.isNotNull(), _parts(F.lit(DEFAULT_SCHEME), prefix))


def parse_legacy_prefix(prefix: Column) -> Column:
    """The older grammar: a bare topic, or exactly SNS|x or SQS|x; anything else is null."""
    parts = F.split(prefix, "\\|")
    two = (F.size(parts) == 2) & F.get(parts, 0).isin("SNS", "SQS")
    return F.when(F.size(parts) == 1, _parts(F.lit("sns"), prefix)).when(two, _parts(F.lower(F.get(parts, 0)), F.get(parts, 1)))


def as_uri(scheme: Column, target: Column) -> Column:
    return F.concat(scheme, F.lit("://"), target)


def valid(scheme: Column, target: Column) -> Column:
    """Both parts there and not blank, the scheme in lower case."""
    ok = (F.trim(scheme) != "") & (F.trim(target) != "") & (scheme == F.lower(scheme))
    return F.coalesce(ok, F.lit(False))


def override(scheme: Column, target: Column, to: tuple[str, str] | None) -> tuple[Column, Column]:
    """Another scheme and target, when both are given; attributes stay."""
    return (F.lit(to[0]), F.lit(to[1])) if to and all(x and x.strip() for x in to) else (scheme, target)

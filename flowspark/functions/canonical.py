"""JSON in one form: keys sorted at every depth, no white space, characters as they are, numbers as Python writes them."""

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def canonical(text: str | None) -> str | None:
    """The one form of a JSON text; null for null, for what doesn't parse, and for numbers that JSON doesn't have."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text, parse_constant=_refuse), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    except (ValueError, RecursionError):
        return None


@arrow_udf(StringType())
def _canonical(texts: pa.Array) -> pa.Array:
    distinct = texts.dictionary_encode()
    return pa.array([canonical(t) for t in distinct.dictionary.to_pylist()], pa.string()).take(distinct.indices)


def canonical_json(c: Column | str) -> Column:
    """``canonical`` of a column of JSON texts, in Arrow batches."""
    return _canonical(F.col(c) if isinstance(c, str) else c)


def event_body(columns: list[str], evidence: str | None = None) -> Column:
    """The body that an event's digest is taken of: its columns as one object and, if named, its evidence beside it.

    Structs, arrays and maps among the columns are sorted at every depth too; nulls stay. Evidence that is no JSON counts
    as a text.
    """
    event = canonical_json(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    if evidence is None:
        return event
    quoted = F.regexp_replace(F.to_json(F.array(evidence)), r"(?s)^\[(.*)\]$", "$1")
    more = F.coalesce(canonical_json(evidence), quoted, F.lit("null"))
    return F.concat(F.lit('{"event":'), event, F.lit(',"evidence":'), more, F.lit("}"))


def event_digest(columns: list[str], evidence: str | None = None) -> Column:
    """SHA-256 of ``event_body``: the same for the same content, whatever the order of keys."""
    return F.sha2(event_body(columns, evidence), 256)

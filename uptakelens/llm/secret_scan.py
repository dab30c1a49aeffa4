"""Secret scans: single matches, and credentials whose parts lie near each other.

Three kinds stand by themselves (the base): values assigned to a secret's name (`assign`), access
identifiers (`access`) and long hexadecimal runs (`hex`). Further parts are weak: a user or
client name (`user`), a service address (`endpoint`) and a random-looking word (`blob`). A weak
part is reported only if complementary parts lie in its scope, that is within SCOPE code points:

* `user` needs a secret (assign, hex or blob) near it;
* `endpoint` needs an identifier (access or user) and a secret (assign or hex);
* `blob` needs an identifier (access or user).

Matches come from regular expressions over whole texts, inside the tasks; only their places go
on. The interval join puts parts in bins of SCOPE code points, sums each bin up as the first
begin and last end of each class, and joins every weak part with the summaries of its own bin
and its two neighbours. That decides exactly whether a part lies within SCOPE, in work linear
in the parts, however many of them one text holds.

A null text is empty and has no spans. Repeated rows each get their own result, an empty table
an empty one; further columns of the input are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptakelens.llm.tables import settled

#: Fixed by the contract, in the order of the kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The weak parts.
USER = re.compile(
    r"""(?:\b|(?<=_))(?:user(?:name|_id)?|login|client_?id|account(?:_id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""",
    re.IGNORECASE | re.ASCII,
)
ENDPOINT = re.compile(
    r"""\b[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.@:_-]+|(?:\b|(?<=_))(?i:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z0-9.:-]+""",
    re.ASCII,
)
BLOB = re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}(?![A-Za-z0-9+/])")
KINDS = ["assign", "access", "hex", "user", "endpoint", "blob"]
BASE = 3
#: Code points within which parts belong together.
SCOPE = 200
_PARTS = pa.list_(pa.struct([("kind", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())]))


def parts(text: str) -> list[dict[str, int]]:
    """Kind, begin and end (code points, exclusive) of every part of a text.

    Greedy runs of 24 or more hexadecimal digits are the same as the greedy runs that are that
    long, so short runs are never visited."""
    named = ":" in text or "=" in text  # without one of them no name is followed by a value
    spans = [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if named else []
    spans += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(2, *m.span()) for m in HEX.finditer(text)]
    spans += [(3, *m.span()) for m in USER.finditer(text)] if named else []
    if not spans:  # every weak part needs a base part or a user name
        return []
    spans += [(4, *m.span()) for m in ENDPOINT.finditer(text)]
    spans += [(5, *m.span()) for m in BLOB.finditer(text)]
    return [{"kind": k, "begin": b, "end": e} for k, b, e in spans]


def _parts(column: pa.Array) -> pa.Array:
    return pa.array([parts(x.as_py() or "") for x in column], _PARTS)


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id and parts of every text, settled: texts are read once."""
    find = F.arrow_udf(_parts, "array<struct<kind:int,begin:bigint,end:bigint>>")
    found = docs.select("doc_id", find("text").alias("parts"))
    return settled(found.withColumn("row", F.monotonically_increasing_id()))


def linked(scan: DataFrame, scope: int = SCOPE) -> DataFrame:
    """row, kind, begin and end of the base parts and of the weak ones that are confirmed."""
    part = scan.select("row", F.explode("parts").alias("p")).selectExpr("row", "p.*")
    bins = "sequence(begin div {0} - {1}, (end - 1) div {0} + {1})"
    own, around = (f"explode({bins.format(scope, n)}) AS bin" for n in (0, 1))
    classes = {"id": "kind IN (1, 3)", "key": "kind IN (0, 2)", "blob": "kind = 5"}
    ranges = [
        x
        for name, test in classes.items()
        for x in (
            F.expr(f"min(begin) FILTER (WHERE {test})").alias(f"{name}_begin"),
            F.expr(f"max(end) FILTER (WHERE {test})").alias(f"{name}_end"),
        )
    ]
    sums = part.selectExpr("row", own, "kind", "begin", "end").groupBy("row", "bin").agg(*ranges)
    weak = part.filter(f"kind >= {BASE}").selectExpr("row", "kind", "begin", "end", around)
    near = {
        name: f"coalesce({name}_begin <= end + {scope} AND {name}_end >= begin - {scope}, false)"
        for name in classes
    }
    met = (
        weak.join(sums, ["row", "bin"])
        .groupBy("row", "kind", "begin", "end")
        .agg(*(F.expr(f"bool_or({test})").alias(f"near_{name}") for name, test in near.items()))
        .filter(
            "kind = 3 AND (near_key OR near_blob) OR kind = 4 AND near_id AND near_key"
            " OR kind = 5 AND near_id"
        )
    )
    columns = ["row", "kind", "begin", "end"]
    return part.filter(f"kind < {BASE}").select(columns).unionAll(met.select(columns))


def joined_spans(kinds: list[str], column: str, most: int) -> str:
    """SQL: the spans of a column, of the first `most` kinds, as kind:begin:end, by begin and
    then by kind, with commas between."""
    names = "array(" + ", ".join(f"'{x}'" for x in kinds) + ")"
    return (
        f"array_join(transform(filter({column}, s -> s.kind < {most}), s ->"
        f" concat({names}[s.kind], ':', s.begin, ':', s.end)), ',')"
    )


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """For every document its doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    scan = scanned(docs)
    span = F.struct("begin", "kind", "end")
    spans = linked(scan, scope).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("found"))
    rows = scan.select("row", "doc_id").join(spans, "row", "left")
    rows = rows.withColumn("found", F.expr("coalesce(found, cast(array() AS array<struct<begin:bigint,kind:int,end:bigint>>))"))
    counts = [
        F.expr(f"bigint(size(filter(found, s -> s.kind = {k})))").alias(f"n_{KINDS[k]}")
        for k in range(BASE)
    ]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(joined_spans(KINDS, "found", BASE)).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined_spans(KINDS, "found", len(KINDS))).alias("spans"),
    )

"""Secret scans, with corpus-wide ownership of what they find.

Each text is scanned for assignments, access keys and hexadecimal strings (the base kinds) and for private keys,
signed tokens and vendors' token formats (the added kinds). The hash of every value found is then
counted over the corpus by distinct repositories and owners: a value that several owners share is a copied
example; one that a single owner has looks live. Spans of the added kinds are reported when they look live,
base spans always.

Repeated (value, repository, owner) rows are combined before they are shuffled and counted, so that a value in a third of
all documents costs no more than others.

Defined results: a null text counts as empty and has no spans; null repositories and owners are not counted,
and a value without any owner looks live; repeated rows are scanned as they are; a text of any length is scanned whole, alone in its
slice of a batch; spans that start at one place are ordered by kind; an empty table gives an empty result; columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import documents, keep, shared_dir, slices, utf8

#: The base patterns, the base kinds in their order.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "key", "jwt", "vendor")
#: Added kinds: literals of which every match holds one at least, so that a text with none is passed over, and the pattern.
#: The formats of private key blocks, of signed tokens and of some vendors' tokens.
MORE = {
    "key": ((b"PRIVATE KEY",), re.compile(rb"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}?-----END ([A-Z]+ )*PRIVATE KEY-----")),
    "jwt": ((b"eyJ",), re.compile(rb"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "vendor": ((b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"github_pat_", b"glpat-", b"xox", b"k_live_"), re.compile(rb"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|rk_live_[A-Za-z0-9]{16,})")),
}
WORDS = re.compile(rb"passw|secret|token|api_?key", re.I)
#: Live-looking values, with their texts' numbers, that are broadcast (some 50 bytes each), so that no text is shuffled; more are joined.
BROADCAST_LIVE = 200_000
#: Distinct owners from which a value counts as a copied example.
EXAMPLE_OWNERS = 3

FOUND = "array<struct<kind:int,start:int,end:int,value:binary>>"


def find(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(kind, start, end, digest of the value) in code points, by start and kind."""
    spans = []
    if WORDS.search(text):
        spans += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in text:
        spans += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    for number, (marks, pattern) in enumerate(MORE.values(), 3):
        if any(mark in text for mark in marks):
            spans += [(number, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    if not spans:
        return []
    spans.sort()
    if not text.isascii():
        at = sorted({x for s in spans for x in s[1:3]})
        points, last, count = {}, 0, 0
        for x in at:
            count += len(text[last:x].decode("utf-8", "ignore"))
            points[x], last = count, x
        spans = [(k, points[a], points[b], v) for k, a, b, v in spans]
    return sorted(((k, a, b, hashlib.sha256(v).digest()) for k, a, b, v in spans), key=lambda s: (s[1], s[0]))


def scan(docs: DataFrame, text: str, carried: dict[str, Column]) -> DataFrame:
    """The carried columns and `found`, the spans of each text."""
    rows = docs.select(*[c.alias(k) for k, c in carried.items()], F.col(text).cast("string").alias("__text"))
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            data, ends = utf8(batch.column(batch.num_columns - 1))
            whole = data.tobytes()
            found = [[dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in find(whole[a:b])] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=[*batch.schema.names[:-1], "found"])

    schema = rows.drop("__text").withColumn("found", F.lit(None).cast(FOUND)).schema
    return rows.mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """By value: how many repositories and owners have it. Expects __repo, __owner, found."""
    values = found.filter(F.size("found") > 0).select("__repo", "__owner", F.explode(F.array_distinct("found.value")).alias("value")).distinct()
    return values.groupBy("value").agg(F.count_distinct("__repo").alias("repositories"), F.count_distinct("__owner").alias("owners"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(spark: SparkSession, docs: DataFrame, carried: dict[str, Column], repo: Column, owner: Column, text: str = "text", most: int = BROADCAST_LIVE) -> DataFrame:
    """The carried columns, `found`, and `live`: the values in the text that look live, null if there is no span."""
    path = shared_dir(spark)
    found = scan(docs, text, {**carried, "__key": F.monotonically_increasing_id(), "__repo": repo.cast("string"), "__owner": owner.cast("string")})
    found = keep(spark, found, f"{path}/found")
    owned = keep(spark, ownership(found), f"{path}/owned")
    live = owned.filter(F.col("owners") < EXAMPLE_OWNERS).select("value")
    hits = found.filter(F.size("found") > 0).select("__key", F.explode(F.array_distinct("found.value")).alias("value"))
    live = keep(spark, hits.join(live, "value").groupBy("__key").agg(F.collect_list("value").alias("live")), f"{path}/live")
    if (live.agg(F.sum(F.size("live"))).first()[0] or 0) <= most:
        live = F.broadcast(live)
    return found.join(live, "__key", "left").drop("__key", "__repo", "__owner")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source", "lang")
    rows = scan_secrets(spark, docs, {"doc_id": F.col("doc_id")}, F.concat_ws("/", "source", "lang"), F.col("source"))
    live = F.coalesce("live", F.array().cast("array<binary>"))
    base = F.filter("found", lambda s: s["kind"] < 3)
    spans = F.filter("found", lambda s: (s["kind"] < 3) | F.array_contains(live, s["value"]))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
    )


def redact(spark: SparkSession, docs: DataFrame, repo: Column, owner: Column, text: str = "text", mask: str = "[secret]", most: int = BROADCAST_LIVE) -> DataFrame:
    """`docs`, every live-looking span in its text replaced by `mask`; copied examples stay. Overlapping spans are
    replaced once, over their union."""
    names = docs.columns
    # Aliased apart, since the columns may have any names.
    carried = {f"c{i}": F.col(f"`{n}`") for i, n in enumerate(names)}
    rows = scan_secrets(spark, docs, carried, repo, owner, text, most)
    body = f"c{names.index(text)}"
    live = F.coalesce("live", F.array().cast("array<binary>"))
    spans = F.filter("found", lambda s: F.array_contains(live, s["value"]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        between = F.col(body).substr(acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(F.concat(acc["out"], between, F.lit(mask)).alias("out"), s["end"].alias("at"))
        wider = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(wider)

    masked = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.col(body).substr(acc["at"] + 1, F.length(body))))
    rows = rows.withColumn(body, F.when(F.size("live") > 0, masked).otherwise(F.col(body)))
    return rows.select(*[F.col(k).alias(n) for k, n in zip(carried, names, strict=True)])



"""Secret scans with multipart credential linking, in built-in functions only.

Three strong kinds are always reported: assigned secrets, access ids and long hex
runs. Three weak kinds say little alone: an account or client identifier, a bare
40-character key, an endpoint. A weak candidate is reported only if parts that
complete it stand in the same document within ``scope`` characters: an identifier
needs a secret, a bare key an identifier, an endpoint both. Strong spans count as
parts: access ids as identifiers, assigned values and hex runs as secrets.

Parts meet candidates in an interval join: parts are summed up by document, block
of ``scope`` characters and role (first start, last end), candidates look up the
blocks that their scope touches. Two parts of one block cannot lie on both sides of
a candidate's scope, so the summed-up bounds decide exactly, and no candidate meets
more than one row for a block and role, however many parts a document holds.

Defined cases: a null text is empty; a weak span that overlaps a strong one, or a
weak one of an earlier kind in the order endpoint, ident, secret, is dropped;
documents that share an id, or have none, are judged each on its own; other columns
are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .matches import match_spans

SCOPE = 300

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ENDPOINT = r"""\b(?i:https?|s3|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+"""
IDENT = r"""\b(?i:access_?key_?id|client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
BARE = r"(?<![A-Za-z0-9/+=_-])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=_-])"

STRONG = ("assign", "access", "hex")
WEAK = ("endpoint", "ident", "secret")
KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
ROLE = {
    "assign": "secret",
    "hex": "secret",
    "secret": "secret",
    "access": "identifier",
    "ident": "identifier",
    "endpoint": "endpoint",
}
NEEDS = {"ident": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its id, and the spans of every kind before linking."""
    body = F.coalesce(F.col(text), F.lit(""))
    values = F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2))
    long_enough = F.transform(values, lambda v: F.length(v) >= 6)
    spans = docs.select(
        F.col(doc_id).alias("doc_id"),
        match_spans(body, ASSIGN, long_enough).alias("assign"),
        match_spans(body, ACCESS).alias("access"),
        match_spans(body, HEX).alias("hex"),
        match_spans(body, ENDPOINT).alias("endpoint"),
        match_spans(body, IDENT).alias("ident"),
        match_spans(body, BARE).alias("secret"),
    )
    earlier = [F.col(k) for k in STRONG]
    for kind in WEAK:
        apart = F.filter(kind, _touches_none(F.concat(*earlier)))
        spans = spans.withColumn(kind, F.when(F.size(kind) > 0, apart).otherwise(F.col(kind)))
        earlier.append(F.col(kind))
    return spans


def _touches_none(others: Column):
    return lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))


def _tagged(kind: str) -> Column:
    """The spans of a kind with its name and role."""
    name, role = F.lit(kind).alias("kind"), F.lit(ROLE[kind]).alias("role")
    return F.transform(kind, lambda s: F.struct(name, role, s["start"].alias("start"), s["end"].alias("end")))


def _exploded(spans: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """A row for each span: row, kind, role, start, end."""
    one = spans.select("row", F.explode(F.concat(*map(_tagged, kinds))).alias("one"))
    return one.select("row", "one.kind", "one.role", "one.start", "one.end")


def link(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak spans that are completed: row, kind, role, start, end. ``spans`` has a column ``row``."""

    def block(c: Column) -> Column:
        return F.floor(c / scope)

    with_weak = spans.where(sum(F.size(k) for k in WEAK) > 0)
    parts = _exploded(with_weak, KINDS)
    summed = (
        parts.withColumn("block", F.explode(F.sequence(block(F.col("start")), block(F.col("end")))))
        .groupBy("row", "block", F.col("role").alias("part"))
        .agg(F.min("start").alias("first"), F.max("end").alias("last"))
    )
    touched = F.sequence(block(F.col("start") - scope), block(F.col("end") + scope))
    near = (F.col("first") <= F.col("end") + scope) & (F.col("last") >= F.col("start") - scope)
    met = (
        _exploded(with_weak, WEAK)
        .withColumn("block", F.explode(touched))
        .join(summed, ["row", "block"])
        .where(near & (F.col("part") != F.col("role")))
        .groupBy("row", "kind", "role", "start", "end")
        .agg(F.collect_set("part").alias("met"))
    )
    complete = F.lit(False)
    for kind, needed in NEEDS.items():
        has_all = F.size(F.array_intersect("met", F.array(*map(F.lit, needed)))) == len(needed)
        complete = complete | ((F.col("kind") == kind) & has_all)
    return met.where(complete).select("row", "kind", "role", "start", "end")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """A row for each document: doc_id, and ``spans`` in order, each with kind, start and end."""
    spans = materialise(find_spans(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "spans")
    linked = link(spans, scope).groupBy("row").agg(F.collect_list(F.struct("kind", "role", "start", "end")).alias("linked"))
    nothing = F.array().cast("array<struct<kind:string,role:string,start:int,end:int>>")
    every = F.concat(*map(_tagged, STRONG), F.coalesce("linked", nothing))
    order = F.transform(
        every, lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), s["end"], s["kind"])
    )
    ordered = F.transform(
        F.array_sort(order), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )
    return spans.join(linked, "row", "left").select("doc_id", *STRONG, ordered.alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op6: secrets of each document."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*STRONG))
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in STRONG],
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )

"""Secret scan: plain patterns, and links between the parts of a multipart credential.

Three families of parts are found in one pass: access identifiers (access keys, client and
user ids), secrets (assigned values, hex runs) and endpoints (URLs, host names with a
port). Weak candidates (long mixed runs of letters and digits, of any length, identifiers, endpoints)
mean little alone: they are reported only where a complementary part lies within `scope`
code points. That is an interval join of parts on (row, block of scope code points), the
one side posted to all its blocks, the other to its own and their neighbours; it is a
semi-join made distinct by span, so nothing multiplies.

Native throughout: DataFrame functions only. The scan's small result is cut to the shared
folder once; texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, table
from .licenses import let

# The patterns of the base kinds. (?i:...) covers letters of the keywords only.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs of 20+: a run begins at its first AKIA, so shorter ones never match
HEX = r"[0-9a-f]{24,}"  # whole runs
BASE = ("assign", "access", "hex")
# The method's own kinds and the family of every kind.
CLIENT = r"(?i:client_?id|user_?name|account_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}"
ENDPOINT = r"(?i:https?|jdbc|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}"
WEAK = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9a-z+/_-]*+[A-Z])(?=[0-9A-Z+/_-]*+[a-z])[A-Za-z0-9+/_-]{32,}+"  # whole runs of 32 or more
FAMILY = {"assign": "secret", "access": "id", "hex": "secret", "client": "id", "endpoint": "endpoint", "weak": "secret"}
KINDS = tuple(FAMILY)
SCOPE = 200
#: Matches whose positions are added up one after another.
BLOCK = 64
SPANS = "array<struct<kind:int,start:long,end:long>>"


def spans(text: Column, pattern: str, kind: int, when: Column, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as (kind, start, end) in code points.

    split() and regexp_extract_all() walk the same matches, so the lengths of the parts
    before and between give the starts. least: code points of group 1 at least, tested
    after matching. Positions run within blocks of BLOCK matches, then blocks are moved to
    their places, so a text of many matches copies no long array for each of them.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if least else whole
    zipped = F.arrays_zip(gaps.alias("g"), F.transform(whole, lambda x: F.char_length(x)).alias("m"), F.transform(values, lambda x: F.char_length(x)).alias("v"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out"))

    def step(a, x):
        start = a["at"] + x["g"]
        end = start + x["m"]
        one = F.array(F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(F.coalesce(end, start).cast("long").alias("at"), F.when(x["m"].isNotNull() & (x["v"] >= least), F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    def moved(parts: Column) -> Column:
        """The blocks' spans at their places: each block starts where those before it end."""
        none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts"))
        starts = F.aggregate(parts, none, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
        shift = lambda x, by: F.struct(x["kind"].alias("kind"), (x["start"] + by).alias("start"), (x["end"] + by).alias("end"))
        return F.flatten(F.zip_with(parts, starts, lambda p, by: F.transform(p["out"], lambda x: shift(x, by))))

    blocks = lambda z: F.transform(F.sequence(F.lit(0), F.size(z) - 1, F.lit(BLOCK)), lambda i: F.aggregate(F.slice(z, i + 1, F.lit(BLOCK)), zero, step))
    return F.when(when, let(let(zipped, blocks), moved)).otherwise(F.array().cast(SPANS))


def join_spans(c: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def by_start(c: Column) -> Column:
    ordered = F.array_sort(F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def scan(docs: DataFrame, id_col="doc_id", text_col="text", scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id, base and all (arrays of (kind number, start, end), by start, then kind).

    Null texts count as empty and have no spans. Repeated rows and null ids stay rows of
    their own. Base spans are always reported; the method's kinds only when linked. Texts may be
    of any length: a row's spans are one array, and links join by blocks of positions. An empty
    table gives no rows; other columns are not read.
    """
    t = F.col("t")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = F.concat(
        spans(t, ASSIGN, 0, t.rlike(ASSIGN), 6),
        spans(t, ACCESS, 1, t.contains("AKIA")),
        spans(t, HEX, 2, t.rlike(HEX)))
    own = F.concat(
        spans(t, CLIENT, 3, t.rlike(CLIENT)),
        spans(t, ENDPOINT, 4, t.contains("://")),
        spans(t, WEAK, 5, t.rlike(WEAK)))
    d = cut(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", by_start(base).alias("base"), by_start(own).alias("own")), "parts")
    family = F.array(*[F.lit(FAMILY[k]) for k in KINDS])
    part = lambda c: d.where(F.size("own") > 0).select("row", F.explode(c).alias("s")).select("row", "s.*", F.element_at(family, F.col("s.kind") + 1).alias("family"))
    block = lambda c: F.floor(c / scope)
    weak = part(F.col("own")).withColumn("block", F.explode(F.sequence(block(F.col("start")), block(F.col("end")))))
    other = part(F.concat("base", "own")).select(F.col("row").alias("row2"), F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("family").alias("family2"))
    other = other.withColumn("block2", F.explode(F.sequence(block(F.col("start2")) - 1, block(F.col("end2")) + 1)))
    linked = weak.join(other, (F.col("row") == F.col("row2")) & (F.col("block") == F.col("block2")) & (F.col("family") != F.col("family2"))
                       & (F.col("start2") - F.col("end") <= scope) & (F.col("start") - F.col("end2") <= scope), "left_semi")
    linked = linked.select("row", "kind", "start", "end").distinct()
    linked = linked.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))  # one text's spans
    got = d.join(linked, "row", "left")
    return got.select("doc_id", "base", by_start(F.concat("base", F.coalesce("linked", F.array().cast(SPANS)))).alias("all"))


def op3_secret_scan(spark, sf_dir):
    got = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return got.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(join_spans(F.col("base")), 256).alias("base_sha256"), join_spans(F.col("all")).alias("spans"))


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLES: dict = {}

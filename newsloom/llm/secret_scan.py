"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong finds are reported as they are: assignments, access identifiers, long hexadecimal runs. Weak ones - tokens that
look random, names of users, clients and accounts, and endpoints - say little alone. They are linked by an interval
join: parts of one text that lie within ``scope`` characters of each other meet in buckets of that width, and a weak
find is reported only where a complement stands beside it. An identifier and an endpoint complement a secret, and a
secret, strong or weak, complements both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import staged

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# Weak parts: a run of 20 characters or more of the base64 alphabet, and an address of a service. Both end where their
# run ends; possessive, so that a long run is read once.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
ENDPOINT = r"(?:[a-z][a-z0-9+.-]{1,15}://|(?<![A-Za-z0-9@.-])(?:api|db|s3|smtp|ftp|vault)\.)[A-Za-z0-9./_:@-]{4,}+"

NAMED = r"""(?i)(?<![a-z0-9])(?:user(?:_?name)?|login|account(?:_?(?:name|id))?|client_?id|(?:access_?)?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+"""
#: What a text with a name or an endpoint has in it.
NAMED_WORDS, ENDPOINT_MARKS = ("user", "login", "account", "client", "key"), ("://", "api.", "db.", "s3.", "smtp.", "ftp.", "vault.")
_RUN = r"[A-Za-z0-9+/_-]{20}"

#: Kinds in the order of a report.
KINDS = ("assign", "access", "hex", "secret", "endpoint", "identifier")
SPANS = "array<struct<start:int,kind:int,stop:int>>"
#: Matches whose places are summed at once.
_SUMMED = 100


def _span(start: Column, kind: int, stop: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), stop.cast("int").alias("stop"))


def find_all(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as spans in code points; ``keep`` is a test of the text of ``group``.

    Places come from the lengths of what stands between the matches and of the matches themselves.
    """
    inside = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), 1, F.size(inside))
    sizes = F.zip_with(between, inside, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("size")))
    begin = lambda at: F.struct(F.array().cast(SPANS).alias("spans"), at.alias("at"))

    def add(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        return F.struct(F.concat(acc["spans"], F.array(_span(first, kind, first + x["size"]))).alias("spans"), (first + x["size"]).alias("at"))

    # an array grows by copying, so places are summed in groups that start where the ones before end
    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _SUMMED).cast("int")), lambda g: F.slice(all_, g * _SUMMED + 1, _SUMMED))
    groups = F.get(F.transform(F.array(sizes), cut), F.lit(0))  # an array of one, so that the matches are found once
    long = lambda group: F.aggregate(group, F.lit(0), lambda n, x: n + x["gap"] + x["size"])

    def after(acc: Column, group: Column) -> Column:
        found = F.aggregate(group, begin(acc["at"]), add, lambda a: a["spans"])
        return F.struct(F.concat(acc["done"], F.array(found)).alias("done"), (acc["at"] + long(group)).alias("at"))

    whole = F.aggregate(groups, F.struct(F.array().cast(f"array<{SPANS}>").alias("done"), F.lit(0).alias("at")), after, lambda acc: F.flatten(acc["done"]))
    spans = F.when(F.size(inside) > 0, whole).otherwise(F.array().cast(SPANS))
    if keep is None:
        return spans
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.filter(F.zip_with(spans, tested, lambda s, t: F.when(keep(t), s)), lambda s: s.isNotNull())


def _only_if(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(SPANS))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, h, assign, access, hex, token, endpoint, named)``: the spans of the parts of every whole text.

    Strong parts are looked for everywhere, weak ones where the text has letters of a complement.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    text, low = F.col("text"), F.lower("text")
    has = lambda c, words: reduce(lambda a, b: a | b, map(c.contains, words))
    named, access, run = has(low, ASSIGN_WORDS), text.contains("AKIA"), text.rlike(_RUN)
    may_name, may_end = has(low, NAMED_WORDS), has(text, ENDPOINT_MARKS)
    secret = named | text.rlike(HEX) | run
    mixed = lambda t: t.rlike("[0-9]") & t.rlike("[a-z]") & t.rlike("[A-Z]")
    return rows.select(
        "id", "h",
        _only_if(named, find_all(text, ASSIGN, 0, lambda t: F.length(t) >= 12, group=2)).alias("assign"),
        _only_if(access, find_all(text, ACCESS, 1)).alias("access"),
        _only_if(text.rlike(HEX), find_all(text, HEX, 2)).alias("hex"),
        _only_if((access | may_name | may_end) & run, find_all(text, TOKEN, 3, mixed)).alias("token"),
        _only_if(may_end & secret & text.rlike(ENDPOINT), find_all(text, ENDPOINT, 4)).alias("endpoint"),
        _only_if(may_name & secret & text.rlike(NAMED), find_all(text, NAMED, 5)).alias("named"),
    )


#: What a weak find of a kind is reported beside: kinds of parts.
_SECRET, _IDENTIFIER, _ENDPOINT = "secret", "identifier", "endpoint"


def _edges(spans: DataFrame, before: str, behind: str) -> DataFrame:
    """The ends of each span that a neighbour's gap is counted from: one neighbour lies ``before``, one ``behind``."""
    edge = lambda at, side: F.struct(F.col(at).alias("at"), F.lit(side).alias("side"))
    return spans.withColumn("edge", F.explode(F.array(edge("span.start", before), edge("span.stop", behind)))).select("*", "edge.at", "edge.side").drop("edge")


def beside(weak: DataFrame, found: DataFrame, scope: int) -> DataFrame:
    """Interval join: the rows of ``weak(key, span, wants)`` that have a part of ``found(key, span, part)`` beside them.

    At most ``scope`` characters are between the two, counted from the end of one to the start of the other, however
    long they are. Ends meet in buckets of that width, which hold few spans as those of a kind do not overlap.
    """
    bucket = F.floor(F.col("at") / scope).cast("int")
    left = _edges(weak, "left", "right").withColumn("bucket", bucket)
    right = _edges(found, "right", "left").select(F.col("key").alias("key_"), F.col("part"), F.col("side").alias("side_"), F.col("at").alias("at_"), F.explode(F.array(*(bucket + d for d in (-1, 0, 1)))).alias("bucket_"))
    met = (F.col("key") == F.col("key_")) & (F.col("wants") == F.col("part")) & (F.col("side") == F.col("side_")) & (F.col("bucket") == F.col("bucket_"))
    gap = F.when(F.col("side") == "left", F.col("at") - F.col("at_")).otherwise(F.col("at_") - F.col("at"))
    return left.join(right, met & gap.between(0, scope), "left_semi").select("key", "span")


def link(found: DataFrame, scope: int = 300) -> DataFrame:
    """``(key, linked)``: weak spans with a complement beside them, by text.

    A token counts beside an identifier or an endpoint, a name and an endpoint beside a secret: a token, an assignment
    or a hexadecimal run. Weak spans that overlap a strong one are that one's and are left out, and so are tokens and
    names in an endpoint; assignments and runs that overlap an access identifier are no secrets of their own.
    """
    some = lambda *names: F.size(F.concat(*names)) > 0
    able = found.where((some("token", "assign", "hex") & some("named", "endpoint")) | (some("token") & some("access")))
    rows = able.select(F.struct("id", "h").alias("key"), F.explode(F.concat("assign", "access", "hex", "token", "endpoint", "named")).alias("span")).distinct()
    rows = rows.select("key", "span", F.col("span.start").alias("start"), F.col("span.stop").alias("stop"), F.col("span.kind").alias("kind"))
    # what starts at or before a span and reaches into it, or starts behind its start and before its end
    up_to = W.partitionBy("key").orderBy("start").rangeBetween(W.unboundedPreceding, 0)
    behind = W.partitionBy("key").orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, -1)

    def meets(*kinds: int) -> Column:
        among = F.col("kind").isin(*kinds)
        reach, follow = F.max(F.when(among, F.col("stop"))).over(up_to), F.min(F.when(among, F.col("start"))).over(behind)
        return F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(follow < F.col("stop"), F.lit(False))

    first = rows.select("*", meets(0, 1, 2).alias("on_strong"), meets(1).alias("on_access"))
    free = first.where(F.when(F.col("kind").isin(0, 2), ~F.col("on_access")).when(F.col("kind") > 2, ~F.col("on_strong")).otherwise(True))
    kept = free.select("*", meets(4).alias("on_endpoint")).where(~(F.col("kind").isin(3, 5) & F.col("on_endpoint")))
    part = F.when(F.col("kind").isin(1, 5), _IDENTIFIER).when(F.col("kind") == 4, _ENDPOINT).otherwise(_SECRET)
    parts_ = staged(kept.select("key", "span", "kind", part.alias("part")), "credential-parts")
    wants = F.when(F.col("kind") == 3, F.array(F.lit(_IDENTIFIER), F.lit(_ENDPOINT))).otherwise(F.array(F.lit(_SECRET)))
    weak = parts_.where("kind > 2").select("key", "span", F.explode(wants).alias("wants"))
    return beside(weak, parts_, scope).groupBy("key").agg(F.collect_set("span").alias("linked"))


def text_of(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """``(id, assign, access, hex, base, spans)`` for every row of ``docs``.

    Spans are ``struct(start, kind, stop)`` in code points, end exclusive, ``kind`` counting in ``KINDS``; ``base`` has the
    strong ones and ``spans`` the linked weak ones too, by start, then kind. A null text counts as empty. Links belong to
    (id, text): repeated rows have the same ones, a null id is an id like others. Other columns are not read; an empty
    table gives an empty result.
    """
    found = staged(parts(docs, id_col, text_col), "secret-finds")
    linked = link(found, scope).select(F.col("key.id").alias("id_"), F.col("key.h").alias("h_"), "linked")
    joined = found.join(linked, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left")
    base = F.array_sort(F.concat("assign", "access", "hex"))
    return joined.select(
        F.col("id").alias(id_col), "assign", "access", "hex", base.alias("base"),
        F.array_sort(F.concat("assign", "access", "hex", F.coalesce("linked", F.array().cast(SPANS)))).alias("spans"),
    )

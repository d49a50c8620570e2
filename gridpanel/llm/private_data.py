"""Personal identifiers by bootstrapped contextual extraction.

Regular expressions with checks (octets, Luhn, number of digits) find the base entities. They are
the seeds: what stands to the left of an entity, up to three chunks of text, gives it lexical
patterns. Identifier-like tokens that are no entity stand under patterns too, and patterns and
values form a graph. In each round a pattern is as sure as the share of its documents in which
a known value of one kind follows it; a value joins when its sure patterns together leave little
doubt, and is known from the next round on. Spans of such values are added to the base spans,
which always stay. Only built-in DataFrame functions are used.

Null texts count as empty. Offsets are code points, ends exclusive. Texts are read whole. Rows are
told apart by ``doc_id`` and text; repeated rows get the same spans. Empty tables give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.session import broadcast_if_small, materialize

# The base patterns. Possessive quantifiers and the look-behinds keep the matches
# of the plain forms and their order, but a run of characters is tried from its start only.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Identifier-like: a whole run of these characters, at least six, with a digit or an at sign.
TOKEN = r"(?<![A-Za-z0-9@._%+/-])(?=[A-Za-z._%+/-]*+[0-9@])[A-Za-z0-9@._%+/-]{6,}+"
#: Of the characters to the left of a span so many are looked at.
CONTEXT = 60

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


@dataclass(frozen=True)
class Settings:
    rounds: int = 3
    least_documents: int = 5  # that hold a known value after the pattern
    least_values: int = 3
    least_share: float = 0.9
    least_belief: float = 0.95
    least_digits: int = 4


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """All matches with their places: what lies between matches, and the matches, add up to the text."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(held: Column, piece: Column) -> Column:
        begin = held["at"] + F.length(piece["gap"])
        end = begin + F.length(piece["hit"])
        found = F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), piece["hit"].alias("value")))
        return F.struct(
            F.coalesce(end, begin).alias("at"), F.when(piece["hit"].isNull(), held["out"]).otherwise(F.concat(held["out"], found)).alias("out")
        )

    return F.aggregate(pieces, start, step)["out"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def _octets(value: Column) -> Column:
    short = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))


def base_spans(text: Column) -> Column:
    """Checked entities of all kinds, by kind and then by place."""
    none = F.array().cast(SPAN)
    digit = text.rlike("[0-9]")
    count = lambda x: F.length(_digits(x["value"]))
    parts = [
        F.when(F.contains(text, F.lit("@")), _spans(text, "email", EMAIL)).otherwise(none),
        F.when(digit & F.contains(text, F.lit(".")), F.filter(_spans(text, "ip", IP), lambda x: _octets(x["value"]))).otherwise(none),
        F.when(digit, F.filter(_spans(text, "card", CARD), lambda x: count(x).between(13, 19) & _luhn(_digits(x["value"])))).otherwise(none),
        F.when(digit & F.contains(text, F.lit("+")), F.filter(_spans(text, "phone", PHONE), lambda x: count(x).between(9, 15))).otherwise(none),
    ]
    return F.concat(*parts)


def _left(text: Column, start: Column) -> Column:
    """The characters before a span, in lower case and with zeros for digits."""
    begin = F.greatest(start - CONTEXT, F.lit(0))
    return F.regexp_replace(F.lower(F.substring(text, begin + 1, start - begin)), "[0-9]", "0")


def _patterns(left: Column) -> Column:
    """The last one, two and three chunks, without those that hold no letter."""
    chunk = r"[^\s]+\s*"
    return F.filter(
        F.array_distinct(F.array(*[F.concat(F.lit(f"{n}:"), F.regexp_extract(left, rf"(?:^|\s)((?:{chunk}){{{n}}})$", 1)) for n in (1, 2, 3)])),
        lambda p: p.rlike(r"^.:.*\p{L}"),
    )


def _grown(seen: DataFrame, settings: Settings) -> DataFrame | None:
    """``value, kind`` of what the graph adds to the base entities, or nothing."""
    edges = materialize(seen.select("key", "value", F.explode("patterns").alias("pattern")).distinct())
    named = seen.where("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind"), F.max("kind").alias("_other"))
    known = materialize(named.where("kind = _other").select("value", "kind"))
    fresh = materialize(seen.where("kind IS NULL").select("value").distinct().join(known, "value", "left_anti"))
    added = None
    of_pattern = materialize(edges.groupBy("pattern").agg(F.countDistinct("key").alias("documents")).where(F.col("documents") >= settings.least_documents))
    for _ in range(settings.rounds):
        hits = edges.join(known, "value").groupBy("pattern", "kind").agg(F.countDistinct("key").alias("hits"), F.countDistinct("value").alias("values"))
        sure = hits.where((F.col("hits") >= settings.least_documents) & (F.col("values") >= settings.least_values)).join(of_pattern, "pattern")
        sure = sure.withColumn("share", F.col("hits") / (F.col("documents") + 1.0)).where(F.col("share") >= settings.least_share)
        sure = materialize(sure.select("pattern", "kind", "share"))
        if sure.isEmpty():
            break
        doubt = edges.join(fresh, "value", "left_semi").join(broadcast_if_small(sure), "pattern").select("value", "kind", "pattern", "share").distinct()
        belief = doubt.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("share"))))).alias("belief"))
        best = belief.groupBy("value").agg(F.max(F.struct("belief", "kind")).alias("_b"))
        new = materialize(best.where(F.col("_b.belief") >= settings.least_belief).select("value", F.col("_b.kind").alias("kind")))
        if new.isEmpty():
            break
        known = materialize(known.union(new))
        fresh = materialize(fresh.join(new, "value", "left_anti"))
        added = new if added is None else materialize(added.union(new))
    return added


def find(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, base, spans``: arrays of ``(kind, start, end)``, by kind in the fixed order and then by place."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.select("doc_id", whole.alias("_text")).withColumn("base", base_spans(F.col("_text")))
    tokens = F.when(F.col("_text").rlike("[0-9@]"), _spans(F.col("_text"), "", TOKEN)).otherwise(F.array().cast(SPAN))
    # tokens that touch a base entity are part of it
    alone = F.filter(tokens, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    alone = F.filter(alone, lambda t: F.length(_digits(t["value"])) >= settings.least_digits)

    def seen(known: bool):
        kind = lambda x: x["kind"] if known else F.lit(None).cast("string")
        return lambda x: F.struct(
            kind(x).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lower(x["value"]).alias("value"), _patterns(_left(F.col("_text"), x["start"])).alias("patterns")
        )

    places = F.concat(F.transform("base", seen(True)), F.transform(alone, seen(False)))
    key = F.struct(F.col("doc_id"), F.xxhash64("_text").alias("h"), F.length("_text").alias("n"))
    narrow = materialize(found.select("doc_id", key.alias("key"), "base", places.alias("places")))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    occurrences = narrow.where(F.size("places") > 0).select("key", F.inline("places"))
    added = _grown(occurrences, settings)
    if added is None:
        return narrow.select("doc_id", plain("base").alias("base"), plain("base").alias("spans"))
    extra = occurrences.where("kind IS NULL").drop("kind").join(added, "value").select("key", "kind", "start", "end").distinct()
    extra = extra.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_more"))  # of one document
    both = narrow.join(extra.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")), "left")
    order = F.array(*map(F.lit, KINDS))

    def before(a: Column, b: Column) -> Column:
        rank = lambda x: F.array_position(order, x["kind"]) * F.lit(1 << 32) + x["start"]
        return F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0)

    spans = F.when(F.col("_more").isNull(), plain("base")).otherwise(F.array_sort(F.concat(plain("base"), F.col("_more")), before))
    return both.select("doc_id", plain("base").alias("base"), spans.alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

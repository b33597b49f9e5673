"""Operator 2: personal data, by bootstrapped contextual extraction (DataFrame functions only).

Four base patterns give the seed entities. A *mention* is a place where an identifier may stand (``MENTION``); one
that holds an entity is a seed of its kind, any other is open. Each mention hangs on four lexical patterns: the
word before it with its own shape, the two words before it, the words on both sides, its shape with the word after
it. A mention that stands next to another takes that one's shape for the word.

Patterns and mentions form a graph that Spark scores in rounds. A mention's confidence in a kind is 1 for seeds,
and for others one less the product of (1 - confidence) of the patterns that it hangs on; a pattern's is the sum of
its mentions' confidences, each without the pattern's own say, over its mentions' number. It counts only where
enough different mentions of high confidence support it - at first seeds, later also what was found, so that
patterns are learned from finds. What stands on patterns of high confidence is personal data of the pattern's
kind, seen by no base pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import cut, text_of

KINDS = ("email", "ip", "card", "phone")

# The base patterns. They are the plain ones
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+                                  phone \+[0-9][\x20().0-9-]+[0-9]
# with possessive repeats, and a match begins only where a run begins (or the last match ended): the same
# matches, found in time that grows with the text and not with the square of a run's length.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Where an identifier may stand: groups of digits joined by spaces, points, brackets, slashes or hyphens, or a word with a digit, an @ or an underscore.
MENTION = r"(?<!\S)(?:[+(]{0,2}[0-9]++(?:[\x20().\-/]{1,3}[0-9]++)++\S*+|[^\s0-9@_]*+[0-9@_]\S*+)"
BYTE = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"

#: Rounds of scoring; the confidence that counts as high; the different mentions that a pattern needs; patterns below WEAK lift no mention.
ROUNDS, CONFIDENT, SUPPORT, WEAK = 3, 0.7, 5, 0.5
#: Elements of an array that are taken together where a sum runs over it: the work grows as the array, not as its square.
BLOCK = 512
_NONE = "array<struct<kind:string,start:int,end:int>>"
_FOUND = "array<struct<start:int,end:int,value:string,gap:string>>"


def _struct(**fields: Column) -> Column:
    """A struct whose fields keep their names inside nested functions of arrays."""
    return F.named_struct(*[x for name, column in fields.items() for x in (F.lit(name), column)])


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, add) -> Column:
    """What ``add`` (a sum or a maximum of numbers from 0 up) makes of all elements before each one, block by block."""
    zero = F.lit(0)
    before = lambda xs: F.aggregate(xs, _struct(at=zero, out=F.array().cast("array<int>")), lambda a, x: _struct(at=add(a["at"], x), out=F.concat(a["out"], F.array(a["at"]))), lambda a: a["out"])
    joined = lambda blocks: F.flatten(F.zip_with(blocks, before(F.transform(blocks, lambda xs: F.aggregate(xs, zero, add))), lambda xs, o: F.transform(before(xs), lambda x: add(o, x))))
    return _let(values, lambda v: F.when(F.size(v) <= BLOCK, before(v)).otherwise(_let(in_blocks(v), joined)))


def in_blocks(values: Column) -> Column:
    """An array (named once) as an array of arrays of ``BLOCK`` elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def spans(text: Column, pattern: str, when: Column) -> Column:
    """The pattern's leftmost non-overlapping matches: array of (start, end, value, gap), in code points, end exclusive.

    The text is split at the matches; the lengths of what lies between (``gap``) and of the matches give the places.
    """
    none = F.array().cast(_FOUND)
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda v, g: _struct(v=v, g=g))
    pairs = F.filter(pairs, lambda p: p["v"].isNotNull())  # the last gap has no match after it
    at = lambda ps: F.zip_with(ps, running(F.transform(ps, lambda p: F.length(p["g"]) + F.length(p["v"])), lambda a, b: a + b), lambda p, n: _struct(start=n + F.length(p["g"]), end=n + F.length(p["g"]) + F.length(p["v"]), value=p["v"], gap=p["g"]))
    return F.when(when, _let(pairs, at)).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    places = F.sequence(F.lit(1), F.length(digits))
    digit = lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(places, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, double(digit(i))).otherwise(digit(i)))
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column) -> dict[str, Column]:
    """Each kind's entities: matches that pass its test; those that fail are dropped and not tried again."""
    has_digit = text.rlike("[0-9]")
    ip_parts = lambda v: F.forall(F.split(v, r"\."), lambda p: p.rlike(BYTE))
    size = lambda v, low, high: F.length(_digits(v)).between(low, high)
    return {
        "email": spans(text, EMAIL, text.contains("@")),
        "ip": F.filter(spans(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda s: ip_parts(s["value"])),
        "card": F.filter(spans(text, CARD, has_digit), lambda s: size(s["value"], 12, 19) & luhn(_digits(s["value"]))),
        "phone": F.filter(spans(text, PHONE, text.contains("+")), lambda s: size(s["value"], 9, 15)),
    }


def _tagged(text: Column) -> list[Column]:
    """Each kind's entities with the kind's name."""
    tag = lambda k, c: F.transform(c, lambda s: _struct(kind=F.lit(k), start=s["start"], end=s["end"]))
    return [tag(k, c) for k, c in base_spans(text).items()]


def _order() -> Column:
    return F.array(*[F.lit(k) for k in KINDS])


def listed(found: Column) -> Column:
    """``kind:start:end`` of each span, by start, then kind as listed, joined by commas."""
    keyed = F.transform(found, lambda s: _struct(start=s["start"], k=F.array_position(_order(), s["kind"]), end=s["end"], kind=s["kind"]))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def shape(value: Column) -> Column:
    """Letters as a, digits as 0, each run once."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"[\p{L}]+", "a"), "[0-9]+", "0")


def row_id(key: str) -> Column:
    """Names a row by its key and text; rows alike in both have the same spans."""
    return F.concat_ws("-", F.col(key).cast("string"), F.hex(F.xxhash64(text_of())), F.length(text_of()))


def annotate(docs: DataFrame, key: str) -> DataFrame:
    """Per row: its name, its base entities, and its mentions with the gaps before them and the text after the last."""
    texts = docs.select(row_id(key).alias("row_id"), F.col(key).cast("long").alias(key), text_of().alias("_text"))
    worth = F.col("_text").rlike("[0-9@_]")
    rest = F.when(worth, F.split("_text", MENTION, -1)[F.size(F.col("mentions"))])
    step = texts.select("row_id", key, "_text", F.concat(*_tagged(F.col("_text"))).alias("base"), spans(F.col("_text"), MENTION, worth).alias("mentions"))
    return step.select("row_id", key, "base", "mentions", F.when(F.size("mentions") > 0, rest).alias("rest"))


def _kind(value: Column) -> Column:
    """The kind of an entity that a mention holds by itself, the first as listed; null if none."""
    out = F.lit(None).cast("string")
    for kind, found in reversed(base_spans(value).items()):
        out = F.when(F.size(found) > 0, kind).otherwise(out)
    return out


def mentions(found: DataFrame) -> DataFrame:
    """A row for every mention and pattern: row_id, start, end, value, kind (of seeds), p. What is no letter or digit at a mention's ends is no part of it."""
    clean = lambda c: F.regexp_replace(c, r"^[^\p{L}\p{N}@+#(]+|[^\p{L}\p{N}]+$", "")
    # every mention with those beside it, side by side in arrays, so that no row carries its text's whole list
    none = F.array(F.lit(None))
    lists = found.where(F.size("mentions") > 0).select(
        "row_id", F.col("mentions").alias("m"), F.concat(none.cast(_FOUND), "mentions").alias("one"), F.concat(none.cast(_FOUND), none.cast(_FOUND), "mentions").alias("two"),
        F.concat(F.transform(F.slice("mentions", F.lit(2), F.size("mentions")), lambda x: x["gap"]), F.array("rest")).alias("after"), F.transform(F.slice("mentions", F.lit(2), F.size("mentions")), lambda x: x["value"]).alias("next"),
    )
    rows = lists.select("row_id", F.explode(F.arrays_zip("m", "one", "two", "after", "next")).alias("z")).where("z.m is not null")
    near = rows.select("row_id", "z.m.start", "z.m.value", "z.m.gap", "z.one", "z.two", "z.after", "z.next")
    plain = lambda c: F.trim(F.lower(F.translate(F.coalesce(c, F.lit("")), "\t\n\r\u000b\f", "     ")))
    last = lambda c, n: F.substring_index(plain(c), " ", -n)
    sign = lambda c: F.coalesce(shape(clean(c)), F.lit(""))
    # what stands before: the gap's last words, before it the mention before and its gap's last word, and so on
    left = F.concat_ws(" ", sign(F.col("two.value")), last(F.col("one.gap"), 1), sign(F.col("one.value")), last(F.col("gap"), 2))
    left = F.regexp_replace(F.trim(left), r"\s+", " ")
    right = F.coalesce(F.nullif(F.substring_index(plain(F.col("after")), " ", 1), F.lit("")), sign(F.col("next")))
    lead = F.length(F.regexp_extract("value", r"^[^\p{L}\p{N}@+#(]+", 0))
    parts = near.select("row_id", (F.col("start") + lead).alias("start"), F.col("value").alias("raw"), clean(F.col("value")).alias("value"), F.substring_index(left, " ", -1).alias("l1"), F.substring_index(left, " ", -2).alias("l2"), right.alias("r1"))
    parts = parts.where(F.col("value").rlike(r"[\p{L}\p{N}]")).withColumn("end", F.col("start") + F.length("value"))
    form = shape(F.col("value"))
    p = F.array(F.concat(F.lit("1 "), "l1", F.lit(" "), form), F.concat(F.lit("2 "), "l2"), F.concat(F.lit("3 "), "l1", F.lit(" "), "r1"), F.concat(F.lit("4 "), form, F.lit(" "), "r1"))
    return parts.select("row_id", "start", "end", F.lower("value").alias("value"), _kind(F.col("raw")).alias("kind"), F.explode(p).alias("p"))


def score_patterns(found: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """Patterns of high confidence: p, kind, confidence. The graph's edges are different (pattern, mention) pairs."""
    edges = cut(found.groupBy("p", "value").agg(F.max("kind").alias("kind")))
    size = edges.groupBy("p").agg(F.count("*").alias("n"))
    seeds = edges.where("kind is not null").select("p", "value", "kind", F.lit(1.0).alias("c"))
    known, patterns = seeds, None
    for i in range(rounds):
        held = known.groupBy("p", "kind").agg(F.sum("c").alias("c"), F.count_if(F.col("c") >= confident).alias("sure")).where(F.col("sure") >= support)
        patterns = cut(held.join(size, "p").select("p", "kind", (F.col("c") / F.col("n")).alias("confidence")))
        if i + 1 == rounds:
            break
        lifted = edges.where("kind is null").select("p", "value").join(patterns.where(F.col("confidence") >= WEAK), "p")
        lifted = lifted.withColumn("doubt", F.when(F.col("confidence") >= 1, F.lit(-30.0)).otherwise(F.log(1 - F.col("confidence"))))
        # what a pattern itself says of a mention is no evidence for the pattern: all others' say, less its own
        total = lifted.groupBy("value", "kind").agg(F.sum("doubt").alias("total"))
        others = lifted.join(total, ["value", "kind"]).select("p", "value", "kind", F.least(1 - F.exp(F.least(F.col("total") - F.col("doubt"), F.lit(0.0))), F.lit(0.999)).alias("c"))
        best = others.groupBy("p", "value").agg(F.max(F.struct("c", "kind")).alias("b")).select("p", "value", F.col("b.kind").alias("kind"), F.col("b.c").alias("c"))
        # a mention that is sure by now supports patterns that were none before
        sure = lifted.groupBy("value", "kind").agg((1 - F.exp(F.sum("doubt"))).alias("c")).where(F.col("c") >= confident).groupBy("value").agg(F.max(F.struct("c", "kind")).alias("b")).select("value", F.col("b.kind").alias("kind"), F.least(F.col("b.c"), F.lit(0.999)).alias("c"))
        fresh = edges.where("kind is null").select("p", "value").join(patterns.select("p").distinct(), "p", "left_anti").join(sure, "value").select("p", "value", "kind", "c")
        known = seeds.unionByName(best).unionByName(fresh)
    return patterns.where(F.col("confidence") >= confident)


def discovered(found: DataFrame, **options) -> DataFrame:
    """Per row with any: the entities that patterns found (array of kind, start, end), none within reach of a base one."""
    edges = mentions(found)
    patterns = score_patterns(edges, **options)
    hits = edges.where("kind is null").drop("kind").join(patterns, "p")
    best = hits.groupBy("row_id", "start", "end").agg(F.max(F.struct("confidence", "kind"))["kind"].alias("kind"), F.lit(False).alias("old"))
    base = found.join(best.select("row_id").distinct(), "row_id", "left_semi").dropDuplicates(["row_id"]).select("row_id", F.explode("base").alias("b")).select("row_id", "b.start", "b.end", "b.kind", F.lit(True).alias("old"))
    # in order of place a span is free if no base one before it reaches into it and the next one begins after it
    order = Window.partitionBy("row_id").orderBy("start", F.desc("old"))
    reach = F.max(F.when(F.col("old"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    next_one = F.min(F.when(F.col("old"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = best.unionByName(base).withColumns({"_reach": reach, "_next": next_one}).where(~F.col("old") & (F.coalesce("_reach", F.lit(0)) <= F.col("start")) & (F.coalesce("_next", F.col("end")) >= F.col("end")))
    return free.groupBy("row_id").agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))


def find_personal_data(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Per row: counts of the base kinds, the digest of the base spans, all spans as text, and how many were discovered.

    Null text counts as empty: no spans, the digest of the empty string. Repeated rows each get a row; other
    columns are ignored; an empty table gives an empty result. ``options`` go to ``score_patterns``.
    """
    found = cut(annotate(docs, key))
    both = found.select("row_id", key, "base").join(discovered(found, **options), "row_id", "left")
    extra = F.coalesce("extra", F.array().cast(_NONE))
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long").alias(f"n_{k}")
    return both.select(key, *[count(k) for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", extra)).alias("spans"), F.size(extra).cast("long").alias("n_discovered"))


def masked(text: Column, found: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; spans that overlap become one, of the first one's kind.

    The text is cut in blocks of spans and each block at its spans, so no step reads it from its start for every span.
    """
    # each span with what all before it reach to; those that begin within that are swallowed
    spans_ = F.array_sort(F.transform(found, lambda s: _struct(start=s["start"], end=s["end"], kind=s["kind"])))
    reached = lambda ss: F.zip_with(ss, running(F.transform(ss, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), lambda s, r: _struct(start=s["start"], end=s["end"], kind=s["kind"], reach=r))

    def block(t: Column, part: Column, first: Column) -> Column:
        """A block's spans over its own text, whose first character has the place ``first``."""
        piece = lambda s: F.when(s["start"] >= s["reach"], F.concat(F.substring(t, F.greatest(s["reach"], first) - first + 1, s["start"] - F.greatest(s["reach"], first)), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.array_join(F.transform(part, piece), "")

    def whole(ss: Column) -> Column:
        one = lambda part: _let(F.substring(text, part[0]["reach"] + 1, F.element_at(part, -1)["start"] - part[0]["reach"]), lambda t: block(t, part, part[0]["reach"]))
        last = F.element_at(ss, -1)
        return F.concat(F.array_join(F.transform(in_blocks(ss), one), ""), F.substring(text, F.greatest(last["reach"], last["end"]) + 1, F.length(text)))

    return F.when(F.size(found) > 0, _let(_let(spans_, reached), whole)).otherwise(text)


def redact(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind in brackets; overlapping spans become one.

    All columns stay, whatever their names. Null texts stay null; repeated rows all stay.
    """
    columns = docs.columns
    # base spans are found anew beside the texts: only what was discovered comes by a join, and while that is little no text is shuffled
    extra = cut(discovered(cut(annotate(docs, key)), **options))
    rows = docs.select(row_id(key).alias("row_id"), F.concat(*_tagged(text_of())).alias("base"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    spans_ = F.concat("base", F.coalesce("extra", F.array().cast(_NONE)))
    text = F.col("_row.text").cast("string")
    new = rows.join(extra, "row_id", "left").select("_row", F.when(F.size(spans_) > 0, masked(text, spans_)).otherwise(F.col("_row.text")).alias("_new"))
    return new.select(*[F.col("_new").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in columns])

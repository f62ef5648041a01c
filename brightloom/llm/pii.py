"""Personal data: base patterns, then bootstrapped contextual extraction, in DataFrame functions only.

Base entities are the seeds. The one or two tokens before an entity, and those after it, are lexical
patterns for its kind; patterns and the values that stand in them form a graph. Each round scores a
pattern by the share of its tokens' occurrences in the corpus that known values of the kind stand beside
(given enough distinct values), and takes the values that confident patterns point at as known, wherever
they stand. Rounds go on until nothing is new. What may become known has the loose shape of its kind, so
a text's other numbers are left alone.

Tokens are runs of letters and digits, in lower case. A context reaches from a match to the one before or
after it in the same pass (of one base pattern, or of the loose shapes), however far that is.

Positions come without Python: matches are put between two characters that no pattern matches, the text
is split there, and running sums over the parts' lengths give places. All steps take time in proportion
to the text, but for sorting its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import between, chunked, cut, free

KINDS = ("email", "ip", "card", "phone")
OPEN, CLOSE, OTHER = "﷐", "﷑", "�"

#: The base patterns, written so that each text is read once: a run is entered only at its start (or
#: where the last match ended), and repeats are possessive. That changes no match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Loose shapes of what contexts may add: one pattern finds them all, then each kind has its own test.
CANDIDATE = r"(?<!\S)[^\s@]*+@\S++|(?<![0-9A-Za-z.:-])[(]?[0-9](?:[\x20().:-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])"
LOOSE = {
    "email": r"^[^\s@]+@[^\s@]+\.[^\s@]+$",
    "ip": r"^[0-9]{1,3}([.:-][0-9]{1,3}){3}$",
    "card": r"^[0-9]{4}([\x20.:-]?[0-9]{4}){2,3}[0-9]{0,3}$",
    "phone": r"^[(]?[0-9]{2,4}[)]?[\x20.-]{1,2}[0-9]{2,4}([\x20.-][0-9]{2,6})+$",
}
MIN_VALUES = 3
MIN_CONFIDENCE = 0.5
#: One text of so many bounds counts from below, before counts over all texts.
BOUND_TEXTS = 64

#: Letters and digits, and all else, for a text in lower case.
TOKEN, GAP = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
_leading = rf"^{GAP}*+({TOKEN}++)(?:{GAP}++({TOKEN}++))?"


def _marked(text: Column, pattern: str) -> Column:
    """The text around and inside each match, in turn."""
    return F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)


def _described(parts: str, kind: int) -> Column:
    """What is needed of each part: its length, the value inside a match, and tokens at both ends of what
    stands between matches (the nearest one; the nearest two)."""

    def part(p: Column, i: Column) -> Column:
        inside, low = i % 2 == 1, F.lower(p)
        back = F.reverse(low)
        a, b = F.regexp_extract(low, _leading, 1), F.regexp_extract(low, _leading, 2)
        c, d = F.reverse(F.regexp_extract(back, _leading, 1)), F.reverse(F.regexp_extract(back, _leading, 2))
        pair = F.when(b != "", F.concat_ws(" ", a, b)), F.when(d != "", F.concat_ws(" ", d, c))
        around = [F.when(~inside, x) for x in (F.nullif(a, F.lit("")), pair[0], F.nullif(c, F.lit("")), pair[1])]
        named = [x.alias(n) for x, n in zip(around, ("head1", "head2", "tail1", "tail2"), strict=True)]
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.char_length(p).cast("long").alias("n"), F.when(inside, p).alias("value"), *named)

    return F.when(F.size(parts) > 1, F.transform(parts, part)).otherwise(F.array().cast(PARTS))


PARTS = "array<struct<kind:int,i:int,n:bigint,value:string,head1:string,head2:string,tail1:string,tail2:string>>"


def _luhn(digits: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid() -> Column:
    """Whether ``value`` passes the test of its ``kind``."""
    value, kind, digits = F.col("value"), F.col("kind"), F.regexp_replace("value", "[^0-9]", "")
    ip = value.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    tests = {"ip": ip, "card": _luhn(digits), "phone": F.length(digits).between(10, 15)}
    out = F.when(kind < 0, F.lit(True))
    for name, test in tests.items():
        out = out.when(kind == KINDS.index(name), test)
    return out.otherwise(F.lit(True))


def base_parts(text: Column) -> dict[str, Column]:
    """For each kind, the parts of the text that its pattern cuts (see ``_described``)."""
    cheap = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]{2}|[0-9][ -][0-9]"), "phone": F.contains(text, F.lit("+"))}
    return {k: F.when(cheap[k], _marked(text, p)).otherwise(F.array(text)) for k, p in BASE.items()}


def _found(rows: DataFrame, text_: str, parts_: str) -> DataFrame:
    """``rows`` with the parts of all matches in the column ``text_``, null where nothing matches."""
    text = F.coalesce(F.col(text_), F.lit(""))
    safe = F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)), F.translate(text, OPEN + CLOSE, OTHER * 2)).otherwise(text)
    t, *names = free(rows, "_t", "_candidate", *[f"_{k}" for k in KINDS])
    rows = rows.withColumn(t, safe)
    cheap = F.contains(F.col(t), F.lit("@")) | F.col(t).rlike("[0-9]{2}")
    cuts = [F.when(cheap, _marked(F.col(t), CANDIDATE)).otherwise(F.array(t)), *base_parts(F.col(t)).values()]
    split = rows.withColumns(dict(zip(names, cuts, strict=True))).drop(t)
    parts = split.withColumn(parts_, F.concat(*[_described(n, i - 1) for i, n in enumerate(names)])).drop(*names)
    return parts.withColumn(parts_, F.when(F.size(parts_) > 0, F.col(parts_)))


def _spans(found: DataFrame) -> DataFrame:
    """Base spans (kind 0..3), and candidates (kind -1) that overlap none of them, of rows with ``row`` and
    ``parts``: row, start, kind, stop, value, left and right (token patterns).

    Rows are dealt by text; one text's matches are sorted and swept once in either direction.
    """
    parts = found.where("parts IS NOT NULL").select("row", F.explode("parts").alias("p")).select("row", "p.*").repartition("row")
    run = Window.partitionBy("row", "kind").orderBy("i")
    stop = F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = {f"{side}{k}": f(f"{end}{k}").over(run) for side, end, f in (("left", "tail", F.lag), ("right", "head", F.lead)) for k in (1, 2)}
    placed = parts.withColumns({"stop": stop} | near).where("value IS NOT NULL").where(_valid()).withColumn("start", F.col("stop") - F.col("n"))
    is_base = F.col("kind") >= 0
    up = Window.partitionBy("row").orderBy("start", F.desc(is_base)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.desc(is_base)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = placed.withColumn("until", F.max(F.when(is_base, F.col("stop"))).over(up)).withColumn("next", F.min(F.when(is_base, F.col("start"))).over(down))
    clear = (F.coalesce("until", F.lit(0)) <= F.col("start")) & (F.coalesce("next", "stop") >= F.col("stop"))
    return swept.where(is_base | clear).select("row", "start", "kind", "stop", "value", "left1", "left2", "right1", "right2")


def _patterns(instances: DataFrame) -> DataFrame:
    """``kind, value, side, gram`` for each context of each instance."""
    sides = [F.struct(F.lit(side).alias("side"), F.col(f"{side}{k}").alias("gram")) for side in ("left", "right") for k in (1, 2)]
    exploded = instances.select("kind", "value", F.col("kind_known").alias("known"), F.explode(F.array(*sides)).alias("c"))
    return exploded.select("kind", "value", "known", "c.*").where("gram IS NOT NULL")


def gram_counts(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """``gram, total``: occurrences of each of ``grams`` (one or two tokens) in the texts ``t``."""
    own = texts.select(F.filter(F.split(F.lower("t"), f"{GAP}+"), lambda w: w != "").alias("w"))
    pairs = F.transform("w", lambda w, i: F.when(i > 0, F.concat_ws(" ", F.get(F.col("w"), i - 1), w)))
    said = own.select(F.explode(F.concat("w", pairs)).alias("gram")).where("gram IS NOT NULL")
    # If few grams are asked for, Spark broadcasts them by its own check of their size and filters first.
    return said.join(grams, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("total"))


def _learn(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """What contexts add to ``spans`` (already written): row, start, kind, stop. texts: ``t``."""
    seeds = spans.where("kind >= 0").withColumn("kind_known", F.lit(1))
    loose = spans.where("kind < 0").drop("kind").withColumn("kind_known", F.lit(0))
    fitting = F.filter(F.array(*[F.when(F.col("value").rlike(LOOSE[k]), F.lit(i)) for i, k in enumerate(KINDS)]), lambda k: k.isNotNull())
    loose = cut(loose.withColumn("kind", F.explode(fitting)), "candidates")
    known = cut(seeds.select("kind", "value").distinct(), "known")
    seen, before = known.count(), -1
    pairs = cut(_patterns(seeds).unionByName(_patterns(loose)).groupBy("kind", "value", "side", "gram").agg(F.count("*").alias("n"), F.min("known").alias("known")), "pairs")
    # Only a pattern of enough values, one of them a candidate, can ever add anything.
    usable = pairs.groupBy("kind", "side", "gram").agg(F.count("*").alias("v"), F.min("known").alias("k"), F.sum("n").alias("most")).where((F.col("v") >= MIN_VALUES) & (F.col("k") == 0))
    grams = cut(usable.groupBy("gram").agg(F.max("most").alias("most")), "grams")
    # Tokens that some of the texts alone have too often for any pattern to be confident need no count over
    # all texts; the bound is exact, so this changes no result. What is left is counted over all texts.
    least = gram_counts(texts.where(F.pmod(F.xxhash64("t"), F.lit(BOUND_TEXTS)) == 0), grams)
    hopeful = cut(grams.join(least, "gram", "left").where(F.coalesce("total", F.lit(0)) * MIN_CONFIDENCE <= F.col("most")).select("gram"), "hopeful")
    totals = cut(gram_counts(texts, hopeful), "totals")
    edges = cut(pairs.drop("known").join(totals, "gram"), "edges")
    pattern = ["kind", "side", "gram"]
    while seen > before:
        score = edges.join(known, ["kind", "value"], "left_semi").groupBy(*pattern).agg(F.count("*").alias("values"), F.sum("n").alias("hits"), F.first("total").alias("total"))
        good = score.where((F.col("values") >= MIN_VALUES) & (F.col("hits") >= MIN_CONFIDENCE * F.col("total")))
        new = edges.join(good.select(*pattern), pattern, "left_semi").select("kind", "value")
        known = cut(known.union(new).distinct(), "known")
        seen, before = known.count(), seen
    # A candidate that fits several kinds has the first.
    return loose.join(known, ["kind", "value"], "left_semi").groupBy("row", "start", "stop").agg(F.min("kind").alias("kind"))


def _all_spans(found: DataFrame, texts: DataFrame) -> DataFrame:
    """``row, start, kind, stop, base`` of base spans and of those that contexts add."""
    spans = cut(_spans(found), "spans")
    added = _learn(texts, spans).select("row", "start", "kind", "stop", F.lit(False).alias("base"))
    return spans.where("kind >= 0").select("row", "start", "kind", "stop", F.lit(True).alias("base")).unionByName(added)


def find_personal(docs: DataFrame) -> DataFrame:
    """``row`` (a number)``, doc_id, base, spans`` for each row of ``docs``: base entities, and those with
    what contexts add (structs of start, kind as a place in KINDS, stop; code points, ``stop`` exclusive),
    by start and kind.

    A null text is empty and has no spans; a null doc_id stays null; repeated rows each give a row;
    columns other than doc_id and text are ignored; an empty table gives no rows. Spans of one kind don't
    overlap; kinds may. An added span overlaps no base span, and has the first kind that fits. All spans
    of one text meet in one row, as the text does.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string").alias("t"))
    found = cut(_found(rows, "t", "parts").drop("t"), "found")
    spans = _all_spans(found, docs.select(F.col("text").cast("string").alias("t")))
    listed = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "base"))).alias("all"))
    joined = found.select("row", "doc_id").join(listed, "row", "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,base:boolean>>"))
    plain = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    return joined.withColumn("every", every).select("row", "doc_id", plain(F.filter("every", lambda s: s["base"])).alias("base"), plain(F.col("every")).alias("spans"))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))))


def personal_digests(docs: DataFrame) -> DataFrame:
    """Counts of base entities, the digest of their spans, and all spans, for each document."""
    counts = [_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return find_personal(docs).select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets, such as ``[EMAIL]``, and n_chars, if
    there, counted anew. Of overlapping spans the first counts, up to the last one's end.

    Rows are written once with their matches; only texts with a match meet their spans, the others stay
    where they are.
    """
    text_, row, parts, cuts = free(docs, "_text", "_row", "_parts", "_cuts")
    numbered = docs.withColumn(text_, F.col("text").cast("string")).withColumn(row, F.monotonically_increasing_id())
    rows = cut(_found(numbered, text_, parts), "numbered")
    spans = _all_spans(rows.select(F.col(row).alias("row"), F.col(parts).alias("parts")), rows.select(F.col(text_).alias("t")))
    merged = _merged(spans).toDF(row, cuts)
    some = rows.where(F.col(parts).isNotNull()).join(merged, row, "left")
    rest = rows.where(F.col(parts).isNull()).select(*docs.columns)
    return rest.unionByName(_replaced(some, docs.columns, text_, cuts))


def _merged(spans: DataFrame) -> DataFrame:
    """``row, cuts``: the spans of each row by start; one that begins inside an earlier one only moves its end."""
    order = Window.partitionBy("row").orderBy("start", "kind", "stop")
    earlier = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("new", (F.coalesce(earlier, F.lit(-1)) <= F.col("start")).cast("int"))
    runs = begins.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.min(F.struct("start", "kind"))["kind"].alias("kind"), F.max("stop").alias("stop"))
    return one.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("cuts"))


def _replaced(rows: DataFrame, columns: list[str], text_: str, cuts: str) -> DataFrame:
    (pieces,) = free(rows, "_pieces")
    rows = rows.withColumn(pieces, F.when(F.col(cuts).isNotNull(), chunked(F.col(text_))))
    tags, chunks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), F.col(pieces)

    def piece(s: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(F.col(cuts), i - 1)["stop"])
        return F.concat(between(chunks, begin, s["start"] - begin), F.get(tags, s["kind"]))

    last = F.element_at(cuts, -1)["stop"]
    text = F.concat(F.concat_ws("", F.transform(cuts, piece)), between(chunks, last, F.char_length(text_) - last))
    out = rows.withColumn("text", F.when(F.col(cuts).isNull(), F.col(text_)).otherwise(text))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*columns)

"""Personal data: fixed patterns, and contexts learned from what they find.

Everything here is DataFrame functions. The base finds e-mail addresses, IP
addresses, card and phone numbers by pattern (leftmost, non-overlapping per
kind) with their positions. These are the seeds of a bootstrap:

* an occurrence is an identifier-like stretch (a word with a digit or an @, or
  a run of digit groups, without the punctuation around it) with the two words
  before it and the word behind it, whatever they are; numbers in them become 9;
* a lexical pattern is a kind with a left pair, or a left and a right word;
* patterns and instances form a graph, scored in rounds until none is accepted
  anew: a pattern by the share
  of its instances that are accepted for its kind times the log of their number
  (RlogF), an instance by the mean log of accepted instances over its patterns;
* instances above ``INSTANCE`` that could be written for the kind are accepted, and the
  best patterns then mark stretches that no base pattern covers.

Occurrences are a small share of the corpus, and the graph's tables are
aggregated per (pattern, instance) before every shuffle, so a frequent context
is a count and not a group. No round collects anything to the driver.

The patterns are written for Java's matcher: possessive, so that no text makes
them backtrack, and anchored by look-behind where a match can only begin at the
beginning of a run.

Defined cases: null and empty texts have no spans; repeated rows are returned
each; very long runs of digits or letters are matched in linear time; a null
doc_id is kept; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.functions.text import let
from litspark.llm.common import checkpointed, table, text_of

LOCAL = "A-Za-z0-9._%+-"
LABEL = "A-Za-z0-9-"
# The base patterns, kind by kind in the order of the results.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: Identifier-like stretches: a word with a digit or an @, and digit groups behind
#: it. What stands around them (``EDGES``) isn't part of them.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:(?<=[0-9)-])[ ][(]?[0-9][0-9().-]*+(?![^\s,;:!?\]}\"']))*+"
EDGES = " ,;:!?.\"'()[]{}<>*#$%&"
STRETCH = 256
#: A pattern needs this many accepted instances, this share of all its
#: instances, and an instance this mean log of support.
SUPPORT, PRECISION, INSTANCE = 3, 0.8, 1.0


#: Matches whose positions are summed up in one go; longer lists go block by block.
BLOCK = 128
_SPANS = "array<struct<start:int,text:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, text>> of all matches: what lies between them tells
    where they are. Positions are code points."""
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda found: F.when(F.size(found) == 0, F.array().cast(_SPANS)).otherwise(
                   let(F.split(text, pattern, -1), lambda between: _placed(found, between))))


def candidates(text: Column) -> Column:
    """array<struct<start, text, l2, l1, r1>> of the identifier-like stretches of a
    text without what encloses them, and the words around them: another stretch
    counts as a word like any other."""
    def around(found: Column, between: Column) -> Column:
        n = F.size(found)
        last = F.concat(F.array(F.lit("")), F.zip_with(F.slice(between, 1, n - 1), F.slice(found, 1, n - 1), lambda b, m: F.concat(b, m)))  # up to the stretch before
        left = F.zip_with(last, F.slice(between, 1, n), lambda m, b: F.concat(m, b))
        next_ = F.concat(F.slice(found, 2, n), F.array(F.lit("")))
        right = F.zip_with(F.slice(between, 2, n), next_, lambda b, m: F.concat(b, m))
        words = F.zip_with(left, right, lambda b, a: F.struct(
            F.regexp_extract(b, r"(?<!\S)(\S++)\s++\S++\s*+$", 1).alias("l2"), F.regexp_extract(b, r"(?<!\S)(\S++)\s*+$", 1).alias("l1"),
            F.regexp_extract(a, r"^\s*+(\S++)", 1).alias("r1")))
        return F.zip_with(_placed(found, between), words, lambda m, w: let(F.ltrim(m["text"], F.lit(EDGES)), lambda bare: F.struct(
            (m["start"] + F.length(m["text"]) - F.length(bare)).alias("start"), F.rtrim(bare, F.lit(EDGES)).alias("text"),
            w["l2"].alias("l2"), w["l1"].alias("l1"), w["r1"].alias("r1"))))

    return F.when(text.rlike("[0-9@]"), let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)),
                                            lambda found: let(F.split(text, CANDIDATE, -1), lambda between: around(found, between))))


def _placed(found: Column, between: Column) -> Column:
    """The matches with their starts: running sums, block by block."""
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found,
                       lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("size"), m.alias("text")))
    return let(steps, lambda all_: let(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_, k * BLOCK + 1, BLOCK)),
        lambda blocks: F.flatten(F.zip_with(blocks, _starts(F.transform(blocks, _length)), _block))))


def _length(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0), lambda a, s: a + s["gap"] + s["size"])


def _starts(lengths: Column) -> Column:
    """Where each block begins."""
    return F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
                       lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]


def _block(steps: Column, at: Column) -> Column:
    return F.aggregate(
        steps, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out")),
        lambda a, s: F.struct((a["at"] + s["gap"] + s["size"]).alias("at"),
                              F.concat(a["out"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), s["text"].alias("text")))).alias("out")))["out"]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    row = F.split(F.reverse(digits), "")
    worth = F.transform(row, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        # more than three digits without leading zeros are above 255 in any case
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(4)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds to (doc_id, text, ...) the arrays of spans of each kind:
    struct<start, text>, in order."""
    digits = F.col("text").rlike("[0-9]")
    gate = {"email": F.contains("text", F.lit("@")), "ip": digits, "card": digits, "phone": F.contains("text", F.lit("+")) & digits}
    out = docs
    for kind, pattern in PATTERNS.items():
        valid = _validator(kind)
        out = out.withColumn(kind, F.when(gate[kind], F.filter(matches(F.col("text"), pattern), valid)).otherwise(F.array().cast(_SPANS)))
    return out


def _validator(kind: str):
    return lambda span: _valid(kind, span["text"])


def _as_span(tag: Column, name: str):
    """A span of a kind, with its end."""
    return lambda s: F.struct(tag.alias(name), s["start"].alias("start"), (s["start"] + F.length(s["text"])).alias("end"), s["text"].alias("text"))


def _word(text: Column) -> Column:
    """A context word: letters only, lower case; numbers become 9."""
    return F.regexp_replace(F.lower(text), r"[0-9]+", "9")


def _stretches(spans: DataFrame) -> DataFrame:
    """A row for every stretch of STRETCH characters that a span touches."""
    return spans.withColumn("part", F.explode(F.sequence(F.floor(F.col("start") / STRETCH).cast("int"), F.floor((F.col("end") - 1) / STRETCH).cast("int"))))


def occurrences(spotted: DataFrame) -> DataFrame:
    """A row per candidate of (row, base, candidates): row, start, end, kind (of a
    base span that overlaps it, else null), instance, context words."""
    found = (spotted.select("row", F.explode("candidates").alias("m"))
             .select("row", F.col("m.start").alias("start"), (F.col("m.start") + F.length("m.text")).alias("end"), "m.text", "m.l2", "m.l1", "m.r1")
             .filter(F.length("text") > 0))
    base = _stretches(spotted.select("row", F.explode("base").alias("s")).select("row", "s.k", "s.start", "s.end", "s.text"))
    b = base.toDF("row_", "k", "start_", "end_", "text_", "part_")
    over = _stretches(found.select("row", "start", "end"))
    over = (over.join(b, (over["row"] == b["row_"]) & (over["part"] == b["part_"]) & (b["start_"] < over["end"]) & (b["end_"] > over["start"]))
            .groupBy(over["row"], over["start"]).agg(F.min(F.struct("k", "start_", "text_")).alias("near")))
    rows = found.join(over, ["row", "start"], "left")
    return rows.select("row", "start", "end", F.coalesce(*[F.when(F.col("near.k") == n, F.lit(k)) for n, k in enumerate(KINDS)]).alias("kind"),
                       F.coalesce("near.text_", "text").alias("instance"), *[_word(F.col(c)).alias(c) for c in ("l1", "l2", "r1")])


def _contexts(occ: DataFrame) -> DataFrame:
    """(pattern, instance, row, start, end, kind) of every occurrence."""
    left_pair = F.concat(F.lit("L:"), "l2", F.lit(" "), "l1", F.lit(" _"))
    around = F.concat(F.lit("M:"), "l1", F.lit(" _ "), "r1")
    some = occ.filter("l1 != ''")  # the first word of a text has no context
    return some.select("row", "start", "end", "kind", "instance", F.explode(F.array(left_pair, around)).alias("pattern"))


def _fits(kind: Column, text: Column) -> Column:
    """Shapes in which a kind may be written at all."""
    n = F.length(_digits(text))
    return (F.when(kind == "email", text.contains("@"))
            .when(kind == "ip", n.between(4, 12) & (F.length(F.regexp_replace(text, r"[^.:]", "")) >= 3))
            .when(kind == "card", n.between(13, 19) & ~text.rlike(r"\p{L}"))
            .otherwise(n.between(7, 15) & ~text.rlike(r"[\p{L}@]")))


def bootstrap(occ: DataFrame) -> DataFrame:
    """(row, start, end, kind) of stretches that learned patterns mark and no
    base span overlaps. Rounds go on until no instance is accepted anew: there
    are finitely many, and none is given up."""
    contexts = checkpointed(_contexts(occ))
    graph = checkpointed(contexts.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("seed")))
    accepted = checkpointed(graph.filter("seed is not null").select("instance", F.col("seed").alias("kind")).distinct())
    total = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
    while True:
        held = graph.join(accepted, "instance").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("good"))
        patterns = checkpointed(held.join(total, "pattern").filter((F.col("good") >= SUPPORT) & (F.col("good") >= PRECISION * F.col("instances")))
                                .select("pattern", "kind", "good", (F.col("good") / F.col("instances") * F.log2(F.col("good"))).alias("score")))
        scored = (graph.filter("seed is null").join(patterns, "pattern").groupBy("instance", "kind")
                  .agg(F.avg(F.log2(F.col("good") + 1)).alias("belief")))
        new = checkpointed(scored.filter((F.col("belief") >= INSTANCE) & _fits(F.col("kind"), F.col("instance"))).select("instance", "kind")
                           .join(accepted, ["instance", "kind"], "left_anti"))
        if new.isEmpty():
            break
        accepted = checkpointed(accepted.unionByName(new))
    marked = (contexts.filter("kind is null").drop("kind").join(patterns.select("pattern", "kind", "score"), "pattern")
              .filter(_fits(F.col("kind"), F.col("instance"))))
    best = marked.groupBy("row", "start", "end").agg(F.max(F.struct("score", "kind")).alias("best"))
    return best.select("row", "start", "end", F.col("best.kind").alias("kind"))


def _listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1),
                                                                                 s["start"].cast("string"), s["end"].cast("string"))))


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, base (array of struct<k, start, end>: the
    kind's number and code points), added (the learned spans)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    base = F.concat(*[F.transform(k, _as_span(F.lit(n), "k")) for n, k in enumerate(KINDS)])
    # the only pass over the texts; from here on a text is its spans and candidates
    spotted = checkpointed(base_spans(rows).select("row", "doc_id", base.alias("base"), candidates(F.col("text")).alias("candidates")))
    added = (bootstrap(occurrences(spotted)).withColumn("k", (F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1).cast("int"))
             .groupBy("row").agg(F.collect_list(F.struct("k", "start", "end")).alias("added")))  # spans of one text
    bare = F.transform("base", lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<k:int,start:int,end:int>>")
    return (spotted.select("row", "doc_id", bare.alias("base")).join(added, "row", "left")
            .select("doc_id", "base", F.coalesce("added", none).alias("added")))


def _of_kind(n: int):
    return lambda span: span["k"] == n


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _of_kind(n))).cast("bigint").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                        _listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_added"))


SQL = None

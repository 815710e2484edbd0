"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base entities (mail addresses, IP addresses, card and phone numbers) are found by pattern in every
text. The corpus then tells which other terms reveal them: over all documents, the pointwise mutual
information of a term and an entity is set against the entity's own information content. A term
that reveals most of it wherever the two stand together is removed, one that reveals much of it is
generalised; both only in documents that hold that entity. Terms beside an entity in fewer than SUPPORT
texts count too, by a smoothed share: for each missing text, one more that has the term alone.

Spans count code points, end exclusive. Patterns start only where a leftmost match can start and
use possessive repeats, so long runs of digits or letters cost linear time.

Only documents with a base entity, and candidate terms, are shuffled; term frequencies of the whole
corpus are summed per task before they move. A candidate list is broadcast only up to a fixed
number of rows, a longer one is joined by shuffle.

Defined results: a null text is empty and has no spans; null doc_ids stay null; repeated rows are
handled one by one, but identical texts count once as evidence; an empty table gives none; other
columns pass through sanitise() and do not matter otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime
from .quality_rules import let

KINDS = ("email", "ip", "card", "phone", "term")
# The patterns of the base entities. \G or a look behind keeps the leftmost start.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried at all.
_HINTS = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: F.contains(t, F.lit("+"))}
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.|$)){4}$"
SPAN = "struct<start:int,kind:int,end:int,value:string>"
#: Distinct texts that a term and an entity share to count as they are (fewer are smoothed), and the shares of the
#: entity's information from which a term is generalised or removed.
SUPPORT, GENERALISE, REMOVE = 5, 0.8, 0.95
#: Spans that are gathered at once.
BLOCK = 256
LEAST_LETTERS, BROADCAST_ROWS, BROADCAST_COPIES = 3, 100_000, 1_000_000


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_OCTETS)
    if kind == "card":
        digits = F.regexp_replace(value, r"[\x20-]", "")
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(value, r"[^0-9]", "")).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, kind: int, valid) -> Column:
    """Spans of the valid matches: the pieces between all matches give their places. Spans are gathered in blocks,
    so that long lists are not copied for each span."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("value")))
    none = F.array().cast(f"array<{SPAN}>")

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value")).cast(SPAN)
        return F.struct((start + F.coalesce(F.length(x["value"]), F.lit(0))).alias("at"), F.when(x["value"].isNotNull() & valid(x["value"]), F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    def block(done: Column, own: Column) -> Column:
        found = F.aggregate(own, F.struct(done["at"].alias("at"), none.alias("spans")), step)
        return let(found, lambda r: F.struct(r["at"].alias("at"), F.concat(done["parts"], F.array(r["spans"])).alias("parts")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("parts"))
    return F.aggregate(let(pieces, in_blocks), start, block, lambda done: F.flatten(done["parts"]))


def in_blocks(items: Column) -> Column:
    """An array cut into arrays of at most BLOCK."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array())


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    found = [F.when(_HINTS[kind](text), matches(text, pattern, k, lambda v, kind=kind: _valid(kind, v))).otherwise(none) for k, (kind, pattern) in enumerate(PATTERNS.items())]
    return F.array_sort(F.concat(*found))


def spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _terms(text: Column) -> Column:
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    return F.filter(words, lambda w: F.length(w) >= LEAST_LETTERS)


def _share(total: int, n_term: Column) -> Column:
    """Of the entity's information, what the term tells; texts short of SUPPORT count as texts with the term alone."""
    own = F.log2(F.lit(float(total)) / F.col("n_entity"))
    smoothed = n_term + F.greatest(F.lit(SUPPORT) - F.col("n_both"), F.lit(0))
    return F.when(own > 0, F.log2(F.lit(float(total)) * F.col("n_both") / (F.col("n_entity") * smoothed)) / own).otherwise(0.0)


def disclosures(found: DataFrame, docs: DataFrame, tables: runtime.Tables) -> DataFrame:
    """entity, term, share: terms that reveal an entity. found has row, copy (a hash of the text), spans and the text of rows with spans.

    All counts are of distinct texts."""
    spark = docs.sparkSession
    copies = tables.write(found.groupBy("copy").agg(F.count("*").alias("copies")), "copies")
    total = copies.count()
    hits = found.where("size(spans) > 0").select("row", "copy", _terms(F.col("text")).alias("terms"), F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"].cast("string"), F.lower(s["value"])))).alias("entities"))
    once = tables.write(hits.join(hits.groupBy("copy").agg(F.min("row").alias("row")).select("row"), "row", "left_semi").select("row", "terms", "entities"), "hits")
    mentions = once.select("row", F.explode("entities").alias("entity"))
    frequent = tables.write(mentions.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= SUPPORT), "entities")
    listed = F.broadcast(frequent) if frequent.count() <= BROADCAST_ROWS else frequent
    rare = mentions.join(listed, "entity", "left_anti").groupBy("entity").agg(F.collect_list("row").alias("rows"))  # fewer than SUPPORT rows each
    kept = mentions.join(listed, "entity").select("row", "entity", "n_entity").union(rare.select(F.explode("rows").alias("row"), "entity", F.size("rows").cast("long").alias("n_entity")))
    words = once.select("row", F.explode("terms").alias("term"))
    # a term is at least as frequent in the corpus as beside personal data, and n_both is n_entity at most: common
    # words end here for all but very common entities, before they are paired
    near = tables.write(words.groupBy("term").agg(F.count("*").alias("n_near")), "near")
    common = near.where(F.col("n_near") > max(20, once.count() // 1000)).withColumnRenamed("n_near", "n_common")
    most = F.pow(F.col("n_entity").cast("double"), F.lit(GENERALISE)) * float(total) ** (1 - GENERALISE) * (1 + 1e-9)
    met = kept.join(words.join(F.broadcast(common), "term", "left"), "row").where(F.col("n_common").isNull() | (F.col("n_common") <= most))
    pairs = met.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"))
    pairs = tables.write(pairs.join(near, "term").where(_share(total, F.col("n_near")) >= GENERALISE).drop("n_near"), "near_pairs")
    candidates = tables.write(pairs.select("term").distinct(), "candidates")
    n_candidates = candidates.count()
    if not n_candidates:
        return spark.createDataFrame([], "entity string, term string, share double")
    # n copies of a text count 1 / n each
    text = F.coalesce(F.col("text"), F.lit(""))
    repeated = copies.where("copies > 1")
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_COPIES else repeated
    weighed = docs.select(text.alias("text"), F.xxhash64(text).alias("copy")).join(repeated, "copy", "left")
    every = weighed.select(F.explode(_terms(F.col("text"))).alias("term"), (1.0 / F.coalesce("copies", F.lit(1))).alias("weight"))
    if n_candidates <= BROADCAST_ROWS:
        every = every.join(F.broadcast(candidates), "term", "left_semi")
    frequency = every.groupBy("term").agg(F.round(F.sum("weight")).alias("n_term"))
    return pairs.join(frequency, "term").select("entity", "term", _share(total, F.col("n_term")).alias("share")).where(F.col("share") >= GENERALISE)


def find(docs: DataFrame, keep: bool = False) -> DataFrame:
    """Each row's base spans, all spans and removed terms (base, spans, gone), beside doc_id or, with keep, the
    whole row as a struct named doc."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc") if keep else F.col("doc_id")
    name = "doc" if keep else "doc_id"
    rows = docs.select(own, text.alias("_text"), base_spans(text).alias("_spans"))
    hit_text = F.when(F.size("_spans") > 0, F.col("_text"))
    stage = runtime.stage(rows.select(name, F.monotonically_increasing_id().alias("_row"), F.xxhash64("_text").alias("_copy"), "_spans", hit_text.alias("_hit")), "spans")
    found = stage.select(F.col("_row").alias("row"), F.col("_copy").alias("copy"), F.col("_spans").alias("spans"), F.col("_hit").alias("text"))
    tables = runtime.Tables(docs.sparkSession)
    reveal = runtime.stage(disclosures(found, docs, tables).groupBy("entity").agg(F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("share") >= REMOVE, F.col("term"))).alias("gone")), "disclosures")
    runtime.delete(docs.sparkSession, tables.folder)
    hits = stage.where("size(_spans) > 0")
    mentions = hits.select("_row", F.explode(F.array_distinct(F.transform("_spans", lambda s: F.concat_ws(":", s["kind"].cast("string"), F.lower(s["value"]))))).alias("entity"))
    flagged = mentions.join(reveal, "entity").groupBy("_row").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("_terms"), F.array_distinct(F.flatten(F.collect_list("gone"))).alias("_gone"))
    # only rows with flagged terms are searched for them
    terms = flagged.join(hits.select("_row", "_hit", F.col("_spans").alias("_own")), "_row")
    clear = lambda s: ~F.exists("_own", lambda b: (s["start"] < b["end"]) & (s["end"] > b["start"]))
    spans = F.filter(matches(F.col("_hit"), r"\p{L}++", 4, lambda v: F.array_contains(F.col("_terms"), F.lower(v))), clear)
    joined = stage.join(terms.select("_row", spans.alias("_extra"), "_gone"), "_row", "left")
    every = F.array_sort(F.concat(F.col("_spans"), F.coalesce(F.col("_extra"), F.array().cast(f"array<{SPAN}>"))))
    return joined.select(name, F.col("_spans").alias("base"), every.alias("spans"), F.coalesce(F.col("_gone"), F.array().cast("array<string>")).alias("gone"))


def sanitised(text: Column, spans: Column, gone: Column) -> Column:
    """The text with entities as [EMAIL] and so on, generalised terms as [TERM], removed ones left out."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def block(done: Column, own: Column) -> Column:
        end = F.greatest(F.array_max(F.transform(own, lambda s: s["end"])), done["at"])

        def built(piece: Column) -> Column:  # what the block's spans lie in: positions count from its start
            def step(made: Column, s: Column) -> Column:
                label = F.when((s["kind"] == 4) & F.array_contains(gone, F.lower(s["value"])), F.lit("")).otherwise(labels[s["kind"]])
                kept = F.substr(piece, made["at"] - done["at"] + 1, F.greatest(s["start"] - made["at"], F.lit(0)))
                # of overlapping spans the later ones only lengthen what is taken out
                return F.struct(F.greatest(made["at"], s["end"]).alias("at"), F.concat(made["text"], kept, F.when(s["start"] >= made["at"], label).otherwise(F.lit(""))).alias("text"))

            return F.aggregate(own, F.struct(done["at"].alias("at"), F.lit("").alias("text")), step)

        made = F.transform(F.array(F.substr(text, done["at"] + 1, end - done["at"])), built)[0]
        return let(made, lambda r: F.struct(r["at"].alias("at"), F.concat(done["parts"], F.array(r["text"])).alias("parts")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    whole = F.aggregate(in_blocks(spans), start, block, lambda done: F.concat(F.array_join(done["parts"], ""), F.substr(text, done["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data and what reveals it taken out of text."""
    clean = sanitised(F.col("doc.text"), F.col("spans"), F.col("gone")).alias("text")
    return find(docs, keep=True).select(*[clean if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])

"""Information-theoretic sanitisation of personal data, with built-in functions only.

Personal data (e-mail and network addresses, card and phone numbers) are found by pattern.
Protected entities are, for each match, its value, the part that several values share (mail
domain, network, issuer, dialling prefix) and its kind. Over all different texts it is
counted how many hold an entity, how many hold a term, and how many hold both. What a term t
discloses of an entity e is the share of the entity's information that the term gives away,

    PMI(e; t) / I(e) = 1 + log2 p(e | t) / I(e),   I(e) = -log2 p(e),

one if e stands wherever t does, zero if they are independent. p(e | t) is the lower end of
the one-sided 95 % Wilson interval, and leaves out the text at hand: every term of a text
stands with the text's entities there, which is no evidence. Terms of a text that disclose at
least ``GENERALISE`` of an entity of that text are generalised wherever they stand in it, those
that disclose at least ``REMOVE`` are removed. Texts without personal data stay as they are.

Terms are runs of at least four letters and digits outside personal data, in small letters.
Equal texts count once. Counting aggregates before it shuffles; no join comes before it, and
what is joined then has one row per term, or per term and entity.

The patterns are possessive forms of plain ones, which find the same matches but
neither recurse nor start again within a run; a match that fails its check is dropped.
A null text is empty. Texts of any length are read whole. Repeated rows have equal results,
one each. Rows without an id are rows like others. An empty table gives an empty table. Other
columns are kept, whatever their names. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from survloom.llm.common import free, table, text_of
from survloom.settings import staged

GENERALISE, REMOVE = 0.6, 0.9
#: Rows of a narrow table (some tens of bytes each) that may go to every task.
FEW_ROWS = 500_000
#: Normal quantile of the interval's confidence.
QUANTILE = 1.645

#: Kinds in their order. A match begins where the last one ended, or where no
#: character of its first class stands before it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TERM = r"[\p{L}\p{N}]{4,}"
_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"


def _length(column: Column) -> Column:
    return F.char_length(column).cast("long")


def _matches(text: Column, pattern: str, rank: int, kind: str) -> Column:
    """Spans of all matches: lengths of the gaps and of the matches, added up in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def add(seen: Column, pair: Column) -> Column:
        begin = seen["at"] + _length(pair["gap"])
        end = begin + _length(pair["value"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(seen["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    spans = F.aggregate(pairs, start, add, lambda seen: seen["spans"])
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(_SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass the check: every second from the right counts double."""
    digits = _digits(value)
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, n + 1 - i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.char_length(_digits(value))
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return {
        "email": F.lit(True),
        "ip": F.regexp_like(value, F.lit(rf"^{part}\.{part}\.{part}\.{part}$")),
        "card": F.when(n.between(12, 19), _luhn(value)).otherwise(F.lit(False)),
        "phone": n.between(9, 15),
    }[kind]


def base_spans(text: Column) -> Column:
    """Spans (start, rank, end, kind, value) of personal data, by start and kind."""
    valid = lambda kind: lambda span: _valid(kind, span["value"])
    kinds = [F.filter(_matches(text, p, rank, kind), valid(kind)) for rank, (kind, p) in enumerate(PATTERNS.items())]
    return F.array_sort(F.concat(*kinds))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entities(span: Column) -> Column:
    """The value, the part that several values share, and the kind of a match."""
    kind, value = span["kind"], F.lower(span["value"])
    digits = _digits(value)
    part = (
        F.when(kind == "email", F.substring_index(value, "@", -1))
        .when(kind == "ip", F.substring_index(value, ".", 2))
        .when(kind == "card", F.substring(digits, F.lit(1), F.lit(6)))
        .otherwise(F.substring(digits, F.lit(1), F.lit(4)))
    )
    whole = F.when(kind.isin("card", "phone"), digits).otherwise(value)
    return F.array(kind, F.concat_ws("/", kind, part), F.concat_ws(":", kind, whole))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def _blanked(text: Column, spans: Column) -> Column:
    """The text without its personal data, a blank in the place of each."""
    return rewritten(text, F.transform(spans, lambda s: s.withField("kind", F.lit("blank"))))


def _small(rows: DataFrame) -> DataFrame:
    """Staged narrow rows, sent to every task if they are few; otherwise Spark chooses the join."""
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows


def lower_bound(k: Column, n: Column) -> Column:
    """Lower end of the one-sided Wilson interval of k successes in n trials; 0 without trials."""
    z = QUANTILE
    spread = F.sqrt(F.greatest(F.lit(0.0), k * (n - k) / n) + z * z / 4)
    return F.when((n > 0) & (k > 0), (k + z * z / 2 - z * spread) / (n + z * z)).otherwise(F.lit(0.0))


def term_counts(rows: DataFrame) -> DataFrame:
    """Rows (term, n_term): how many different texts hold each term.

    ``rows`` has text and ``copies``, the number of rows with that text (null: one). Copies
    count as their parts of one, in 18 decimals, which add up to whole numbers when rounded.
    """
    part = (F.lit(1).cast("decimal(20,18)") / F.col("copies").cast("decimal(18,0)")).cast("decimal(28,18)")
    spoken = rows.select("copies", F.explode(_words(F.col("text"))).alias("term"))
    total = F.count(F.when(F.col("copies").isNull(), 1)) + F.round(F.coalesce(F.sum(part), F.lit(0))).cast("long")
    return spoken.groupBy("term").agg(total.alias("n_term"))


def disclosing(rows: DataFrame, texts: int, mentions: DataFrame, holders: DataFrame) -> DataFrame:
    """Rows (entity, term, share) above the lower threshold.

    ``rows`` are as for :func:`term_counts` and hold so many different ``texts``;
    ``mentions`` has one row (entity, term) for each text that holds both, ``holders`` counts
    the texts of each entity (entity, n_entity).
    """
    pairs = mentions.groupBy("entity", "term").agg(F.count("*").alias("n_both")).filter("n_both > 1")
    found = pairs.join(holders, "entity").join(term_counts(rows), "term")
    information = -F.log2(F.col("n_entity") / F.lit(max(1, texts)))
    known = lower_bound(F.col("n_both") - 1, F.greatest("n_both", "n_term") - 1)
    share = F.when((information > 0) & (known > 0), 1 + F.log2(known) / information).otherwise(F.lit(0.0))
    return found.select("entity", "term", share.alias("share")).filter(F.col("share") >= GENERALISE)


def _places(texts: DataFrame, told: DataFrame) -> DataFrame:
    """Rows (key, start, end, share): where the terms of ``told`` (key, term, share) stand in their texts."""
    keys = _small(staged(told.select("key").distinct(), "keys"))
    held = texts.select("key", "text").join(keys, "key", "left_semi").dropDuplicates(["key"])
    words, gaps = F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)), F.split("text", _TERM, -1)
    cut = held.select("key", F.posexplode(F.arrays_zip(gaps.alias("gap"), words.alias("word"))).alias("i", "w"))
    upto = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    length = _length(F.col("w.gap")) + F.coalesce(_length(F.col("w.word")), F.lit(0))
    cut = cut.select("key", "w.word", F.sum(length).over(upto).alias("end")).filter("word IS NOT NULL")
    cut = cut.select("key", F.lower("word").alias("term"), (F.col("end") - _length(F.col("word"))).alias("start"), "end")
    return cut.join(told, ["key", "term"]).select("key", "start", "end", "share")


def detected(docs: DataFrame) -> DataFrame:
    """From rows with key (hash of the text) and text: rows (key, base, spans) of the texts with spans.

    ``spans`` holds the base spans and those of terms (kinds ``generalised`` and
    ``removed``), by start and kind. Tables that texts are joined with are written first,
    so that their size is known and texts are shuffled only if they are large.
    """
    docs = docs.select("key", "text")
    counted = docs.groupBy("key").agg(F.count("*").alias("copies"))
    copied = staged(counted.filter("copies > 1"), "copies")
    more = copied.agg(F.sum(F.col("copies") - 1)).first()[0] or 0
    found = docs.withColumn("base", base_spans(F.col("text"))).filter(F.size("base") > 0)
    entities = F.array_distinct(F.flatten(F.transform("base", _entities)))
    found = found.select("key", "base", entities.alias("entities"), _words(_blanked(F.col("text"), F.col("base"))).alias("terms"))
    found = staged(found.dropDuplicates(["key"]), "privacy")
    # An entity of one text alone has nothing to be learnt from.
    holders = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    holders = staged(holders.filter("n_entity > 1"), "entities")
    named = found.select("key", "terms", F.explode("entities").alias("entity")).join(holders.select("entity"), "entity")
    mentions = named.select("key", "entity", F.explode("terms").alias("term"))
    shares = staged(disclosing(docs.join(copied, "key", "left"), docs.count() - more, mentions, holders), "shares")
    told = staged(mentions.join(_small(shares), ["entity", "term"]).groupBy("key", "term").agg(F.max("share").alias("share")), "told")
    kind = F.when(F.col("share") >= REMOVE, "removed").otherwise("generalised")
    rank = F.when(F.col("share") >= REMOVE, len(PATTERNS) + 1).otherwise(len(PATTERNS))
    span = F.struct("start", rank.alias("rank"), "end", kind.alias("kind"), F.lit(None).cast("string").alias("value"))
    placed = _places(docs, told).groupBy("key").agg(F.collect_list(span).alias("placed"))
    joined = found.select("key", "base").join(placed, "key", "left")
    free_of = F.filter(F.col("placed").cast(_SPAN), lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"])))
    spans = F.array_sort(F.concat("base", F.coalesce(free_of, F.array().cast(_SPAN))))
    return staged(joined.select("key", "base", spans.alias("spans")), "spans")


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def analysed(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows doc_id, base and spans, one for each row of ``df``; see :func:`detected`."""
    docs = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df[text]).alias("text"))
    docs = docs.withColumn("key", _key(F.col("text")))
    found = detected(docs)
    none = F.array().cast(_SPAN)
    joined = docs.select("doc_id", "key").join(found, "key", "left")
    return joined.select("doc_id", *(F.coalesce(c, none).alias(c) for c in ("base", "spans")))


def rewritten(text: Column, spans: Column) -> Column:
    """The text with each span replaced: personal data and generalised terms by their kind."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(seen: Column, span: Column) -> Column:
        shown = F.when(span["kind"] == "removed", F.lit("")).when(span["kind"] == "blank", F.lit(" ")).when(span["kind"] == "generalised", F.lit("<TERM>"))
        shown = shown.otherwise(F.concat(F.lit("<"), F.upper(span["kind"]), F.lit(">")))
        before = F.substring(text, (seen["at"] + 1).cast("int"), (span["start"] - seen["at"]).cast("int"))
        parts = F.when(span["start"] >= seen["at"], F.concat(seen["parts"], F.array(before, shown))).otherwise(seen["parts"])
        return F.struct(F.greatest(seen["at"], span["end"]).alias("at"), parts.alias("parts"))

    def end(seen: Column) -> Column:
        rest = F.substring(text, (seen["at"] + 1).cast("int"), F.char_length(text))
        return F.concat(F.array_join(seen["parts"], ""), rest)

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, end)).otherwise(text)


def sanitise(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with personal data and disclosing terms replaced in the text.

    All rows and columns are kept; a null text stays null.
    """
    key, spans = free(df, "key"), free(df, "spans")
    rows = df.withColumn(key, _key(text_of(df[text])))
    found = detected(rows.select(F.col(key).alias("key"), text_of(rows[text]).alias("text")))
    found = found.select(F.col("key").alias(key), F.col("spans").alias(spans))
    joined = rows.join(found, key, "left")
    new = F.when(F.col(spans).isNull(), F.col(text)).otherwise(rewritten(F.col(text), F.col(spans)))
    return joined.withColumn(text, new).select(*df.columns)


def op4_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and offsets of personal data, and all spans, for every document."""
    rows = analysed(table(spark, sf_dir, "documents"))
    of = lambda kind: lambda span: span["kind"] == kind
    counts = [F.size(F.filter("base", of(kind))).cast("long").alias(f"n_{kind}") for kind in PATTERNS]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

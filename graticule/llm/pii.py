"""Personal data by patterns and by disclosure, on built-in expressions only.

The patterns find protected entities: addresses and numbers, each value an entity. How strongly a
term reveals an entity is estimated from the corpus: the pointwise mutual information of term and
entity over the entity's own information content, 1 for a term that occurs with the entity only.
Terms at or above the threshold are found too, in every text that has the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.llm.spans import Pattern, counted, joined, spans_of
from graticule.llm.tables import stored

#: A term reveals an entity from this share of the entity's information content, and only if it
#: was seen with it in so many different texts (copies of a text are one).
DISCLOSURE, SUPPORT = 0.9, 3
TERM = "term"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column) -> Column:
    def octet(part: Column) -> Column:
        plain = F.ltrim(part, F.lit("0"))
        return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), octet)


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    padded = F.lpad(digits, 20, "0")

    def add(total: Column, place: Column) -> Column:
        digit = padded.substr(place, F.lit(1)).cast("int") * F.when(place % 2 == 1, 2).otherwise(1)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), add)
    return F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(F.lit(False))


BASE = (
    Pattern("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None,
            lambda t: F.contains(t, F.lit("@"))),
    Pattern("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _octets, lambda t: t.rlike(r"[0-9]\.[0-9]")),
    Pattern("card", r"[0-9](?:[\x20-]?[0-9])++", _luhn, lambda t: t.rlike(r"(?:[0-9][\x20-]?){13}[0-9]")),
    Pattern("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(_digits(v)).between(10, 15), lambda t: F.contains(t, F.lit("+"))),
)
KINDS = (*(p.kind for p in BASE), TERM)
_NO_SPANS = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"


def base_spans(text: Column) -> Column:
    return F.concat(*[spans_of(text, p) for p in BASE])


def _terms(text: Column) -> Column:
    """Runs of letters, three or more."""
    return F.filter(F.split(text, r"[^\p{L}]+"), lambda w: F.length(w) >= 3)


def disclosures(docs: DataFrame, *, threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``entity, term, disclosure``: the terms that reveal an entity, from all of ``text``.

    Counts are of rows: N all, n(e) and n(t) with the entity or term, n(e, t) with both, wherever
    they stand in the text. The disclosure is log(n(e,t) N / (n(e) n(t))) / log(N / n(e)). An entity in fewer
    different texts than ``support`` cannot have a term in so many, so only the others' texts are
    cut into terms.
    """
    numbered = docs.select("text", base_spans(F.col("text")).alias("spans")).filter(F.size("spans") > 0)
    entities = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))
    seen = stored(numbered.select(F.xxhash64("text").alias("blob"), F.explode(entities).alias("entity")), "entities")
    # Rows of equal texts are counted once each, and looked into once.
    times = seen.groupBy("entity", "blob").agg(F.count(F.lit(1)).alias("rows"))
    often = times.groupBy("entity").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support)
    wanted = stored(times.join(often.select("entity"), "entity"), "shared_entities")
    held = (docs.select("text", F.xxhash64("text").alias("blob")).join(wanted.select("blob").distinct(), "blob", "left_semi")
            .groupBy("blob").agg(F.any_value(F.array_distinct(_terms(F.col("text")))).alias("terms")))
    pairs = (wanted.join(held, "blob").select("entity", "rows", F.explode("terms").alias("term"))
             .groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("rows").alias("n_et")).filter(F.col("contexts") >= support))
    pairs = stored(pairs, "pairs")
    n_entity = times.groupBy("entity").agg(F.sum("rows").alias("n_e"))
    # Counted before they meet the pairs: tasks send one row a term, not one for each of its texts.
    words = docs.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    measured = pairs.join(n_entity, "entity").join(words, "term").withColumn("n", docs.agg(F.count(F.lit(1))).scalar())
    ratio = F.log(F.col("n_et") * F.col("n") / (F.col("n_e") * F.col("n_t"))) / F.log(F.col("n") / F.col("n_e"))
    return measured.filter("n_e < n").select("entity", "term", ratio.alias("disclosure")).filter(F.col("disclosure") >= threshold)


def with_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = DISCLOSURE,
               support: int = SUPPORT) -> DataFrame:
    """``row, text, spans``: each row of ``docs`` as a struct, its text and all its spans.

    Base spans are in every row; term spans are added where a text has an entity that the term
    reveals, except inside base spans. Null texts count as empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"))
    terms = stored(disclosures(rows, threshold=threshold, support=support), "disclosures")
    based = rows.withColumn("spans", base_spans(F.col("text")))
    revealing = (based.filter(F.size("spans") > 0)
                 .select(F.sha2("text", 256).alias("blob"), F.explode("spans").alias("s"))
                 .select("blob", F.concat_ws(":", F.col("s.kind"), F.lower("s.value")).alias("entity")).distinct()
                 .join(terms, "entity").groupBy("blob").agg(F.collect_set("term").alias("terms")))
    # Only texts that hold an entity are dealt out to meet its terms.
    open_rows = based.filter(F.size("spans") > 0).withColumn("blob", F.sha2("text", 256)).join(revealing, "blob", "left").drop("blob")
    joined_up = open_rows.unionByName(based.filter(F.size("spans") == 0).withColumn("terms", F.lit(None).cast("array<string>")))
    regex = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    added = F.filter(spans_of(F.col("text"), Pattern(TERM, regex)), lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return joined_up.select("row", "text", F.concat("spans", F.when(F.col("terms").isNotNull(), added).otherwise(F.array().cast(_NO_SPANS))).alias("spans"))


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of each row.

    Null texts count as empty, ids may be null or repeat (repeated rows are judged alike), and an
    empty table gives an empty one.
    """
    base = F.filter("spans", lambda s: s["kind"] != TERM)
    return with_spans(docs, id_col=id_col, text_col=text_col, threshold=threshold, support=support).select(
        F.col("row")[id_col].cast("long").alias("doc_id"), *[counted(F.col("spans"), p.kind).alias(f"n_{p.kind}") for p in BASE],
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))


def sanitised(docs: DataFrame, *, text_col: str = "text", threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """The rows of ``docs`` with every span generalised to its kind, like ``<EMAIL>``.

    Overlapping spans become one mark, that of the first. Texts without spans, null ones among
    them, stay as they are, and so do all other columns.
    """
    def put(state: Column, s: Column) -> Column:
        new = s["start"] >= state["at"]
        gap = F.col("text").substr((state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        return F.struct(F.when(new, F.concat(state["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(state["out"]).alias("out"),
                        F.greatest(state["at"], s["end"]).alias("at"))

    held = with_spans(docs, text_col=text_col, threshold=threshold, support=support)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(F.array_sort("spans"), start, put)
    clean = F.concat(done["out"], F.col("text").substr((done["at"] + 1).cast("int"), F.length("text")))
    text = F.when(F.size("spans") > 0, clean).otherwise(F.col("row")[text_col])
    return held.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])

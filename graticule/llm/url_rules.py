"""URL filtering by listed rules and by association rules mined from labelled URLs.

URLs become sets of tokens (scheme, host labels, path words, ending, query keys, fragment).
FP-growth mines token combinations that go with a label; rules of high confidence and support are
kept. Each is filed under its rarest token,
so a URL meets only rules of which it has that token, and the whole antecedent is then verified.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.llm.tables import stored

#: Share of labelled URLs with the antecedent and the label; share of the antecedent's URLs.
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.9
#: Sources of labels (list entries) that must speak for a rule; one asks for nothing more than the two above.
MIN_SOURCES = 1
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """A listed rule: it fits a host and its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule(BLOCK, "net", "/"), Rule(ALLOW, "example.net", "/en/"), Rule(BLOCK, "example.com", "/de/"), Rule(ALLOW, "org", "/fr/"))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) host of a URL; empty without ``://`` and for null."""
    host = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"\A([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"\A[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Name of the longest listed rule that fits, else null."""
    fits = [F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)), r.name)
            for r in sorted(rules, key=lambda r: (-len(r.name), r.name))]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL."""
    def named(kind: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(kind + "="), v))

    query = F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda v: F.regexp_extract(v, r"\A([^=]*)", 1))
    one = F.array(F.regexp_extract(url, r"\A([A-Za-z]+)://", 1))
    ending = F.array(F.regexp_extract(path, r"\.([A-Za-z]+)\z", 1))
    fragment = F.array(F.when(F.contains(url, F.lit("#")), "any").otherwise(""))
    return F.array_distinct(F.concat(named("scheme", one), named("host", F.split(host, r"\.")), named("path", F.split(path, "/")),
                                     named("ending", ending), named("key", keys), named("fragment", fragment)))


def _matches(urls: DataFrame, mined: DataFrame) -> DataFrame:
    """``urls`` by each mined rule whose antecedent they hold, by an inverted index of the rules."""
    index = mined.select(F.col("rarest").alias("token"), "antecedent", "label", "confidence", "support")
    held = urls.withColumn("token", F.explode("tokens")).join(index, "token")
    return held.filter(F.size(F.array_except("antecedent", "tokens")) == 0).drop("token")


def mine(labelled: DataFrame, *, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         min_sources: int = MIN_SOURCES) -> DataFrame:
    """``antecedent, label, confidence, support, rarest`` mined from ``tokens, label, source`` rows.

    A rule is dropped if a part of its antecedent already gives the label with the same
    confidence or more, or if fewer than ``min_sources`` sources have URLs that it fits.
    """
    baskets = labelled.select(F.array_union("tokens", F.array(F.concat(F.lit("label="), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    frequent = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rules = (model.associationRules.filter(F.startswith(F.col("consequent")[0], F.lit("label=")))
             .filter(~F.exists("antecedent", lambda t: F.startswith(t, F.lit("label="))))
             .select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 7, 1 << 20).alias("label"), "confidence", "support"))
    rules = stored(rules, "rules")
    parts = rules.select(F.col("label").alias("l"), F.col("confidence").alias("c"), F.col("antecedent").alias("part"), F.col("antecedent")[0].alias("t"))
    held = rules.withColumn("t", F.explode("antecedent"))
    implied = (held.join(parts, (held["t"] == parts["t"]) & (F.col("label") == F.col("l")) & (F.size("part") < F.size("antecedent")) & (F.col("c") >= F.col("confidence")))
               .filter(F.size(F.array_except("part", "antecedent")) == 0).select("antecedent", "label").distinct())
    lean = rules.join(implied, ["antecedent", "label"], "left_anti")
    rarest = (lean.select("antecedent", "label", F.explode("antecedent").alias("token")).join(frequent, "token")
              .groupBy("antecedent", "label").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest")))
    filed = stored(lean.join(rarest, ["antecedent", "label"]), "filed")
    urls = labelled.select("tokens", F.col("label").alias("own"), "source")
    backed = (_matches(urls, filed).filter("own = label").groupBy("antecedent", "label")
              .agg(F.count_distinct("source").alias("sources")).filter(F.col("sources") >= min_sources))
    return filed.join(backed.select("antecedent", "label"), ["antecedent", "label"])


def judge(pages: DataFrame, *, rules: tuple[Rule, ...] = RULES, labels: DataFrame | None = None, id_col: str = "page_id",
          url_col: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
          min_sources: int = MIN_SOURCES) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined`` of each row.

    ``rule`` is the longest listed rule that fits, and gives the verdict. Other URLs get that of
    the mined rule of highest confidence, then support, that they fit (``mined`` names it), or
    allow. ``labels`` (url, label allow or block, source) are what is mined; by default all URLs
    that a listed rule fits, with its verdict, and the rule as source. A null URL or one without
    ``://`` has empty host and path and is allowed; ids may be null or repeat. Empty tables, or no
    labels, mine nothing. Equal URLs are judged once, however many rows have them.
    """
    url = F.col(url_col).cast("string")
    verdicts = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.verdict))]).cast("map<string,string>")
    each = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"))
    each = each.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    each = each.withColumn("rule", listed(F.col("host"), F.col("path"), rules))
    tokens = tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens")
    if labels is None:
        known = each.filter("rule is not null").select(tokens, verdicts[F.col("rule")].alias("label"), F.col("rule").alias("source"))
    else:
        known = labels.select("url", "label", "source", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).filter(
            "url is not null and label is not null").select(tokens, "label", "source")
    known = stored(known, "labelled")
    if known.isEmpty():
        return each.select("page_id", "host", "path", "rule", F.coalesce(verdicts[F.col("rule")], F.lit(ALLOW)).alias("verdict"), F.lit(None).cast("string").alias("mined"))
    mined = mine(known, min_support=min_support, min_confidence=min_confidence, min_sources=min_sources)
    open_urls = each.filter("rule is null and host <> ''").select("url", tokens).distinct()
    best = (_matches(open_urls, mined).groupBy("url")
            .agg(F.max_by(F.struct("label", F.array_join("antecedent", " ").alias("mined")), F.struct("confidence", "support", "label", "antecedent")).alias("best")))
    return each.join(best, "url", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce(verdicts[F.col("rule")], F.col("best.label"), F.lit(ALLOW)).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("best.mined")).alias("mined"))

"""Searches of many users at once: whole tables of searches against catalog and granules.

No search is compared with every record. A catalog search has up to five keys (one of its words,
an identifier, a name, a provider, a level); records are listed under theirs in an inverted index,
and a search reads only the list that is shortest. Lists hold what filters ask of a record, so a search
tests all but its words where it meets the list, and only what is left meets the texts. Searches
that ask the same are answered once. Results stand by identifier, so the lists are read in that
order, in rounds of growing length, and a search that has its rows leaves: what it would meet later
could only stand behind them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.operators.area import contains_join
from graticule.operators.coverage import AREA, DEFAULT_LIMIT, once_each, overlap_join
from graticule.session import cut_lineage

#: Rows that one search may ask for.
MOST_ROWS = 50

#: What a catalog search may hold; absent columns count as null.
SEARCH_COLUMNS = {
    "keyword": "string", "concept_id": "string", "short_name": "string", "provider": "string", "levels": "array<string>",
    "has_granules": "boolean", "t0": "timestamp_ntz", "t1": "timestamp_ntz", "w": "double", "s": "double", "e": "double", "n": "double",
}

#: What a granule search may hold besides ``request_id`` and ``collection_id``.
GRANULE_SEARCH_COLUMNS = {
    "t0": "timestamp_ntz", "t1": "timestamp_ntz", "w": "double", "s": "double", "e": "double", "n": "double",
    "cloud_min": "double", "cloud_max": "double", "day_night_flag": "string", "sort_key": "string",
}

#: Granule columns to sort by; ``-`` in front turns the order.
SORT_COLUMNS = ("time_start", "time_end", "granule_ur", "cloud_cover", "size_mb")

#: So many first records, by identifier, are met in each of the first rounds of a catalog search.
_ROUNDS = (128, 1024, 8192, 65536)

#: Rounds beyond those reach about so many times as far as the one before, up to the last record.
_FARTHER = 8

_WHITE = r"\s+"


def _words(text: Column) -> Column:
    """Distinct lower-case words, parted at white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), _WHITE), lambda x: x != ""))


def _with_columns(searches: DataFrame, known: dict[str, str], limit: int) -> DataFrame:
    """The known columns in their types, absent ones null, and ``limit`` with its default and bound."""
    asked = F.col("limit").cast("long") if "limit" in searches.columns else F.lit(None).cast("long")
    return searches.select(
        *[searches[c] for c in ("search_id", "request_id", "collection_id") if c in searches.columns],
        *[(F.col(c) if c in searches.columns else F.lit(None)).cast(t).alias(c) for c, t in known.items()],
        F.least(F.coalesce(asked, F.lit(limit)), F.lit(MOST_ROWS)).alias("limit"),
    )


def _top(found: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The first rows of each search, with ``rank`` from 1; each task keeps no more than any search may have."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("rank") <= MOST_ROWS).where(F.col("rank") <= F.col("limit"))


def _index(records: DataFrame) -> DataFrame:
    """``kind, value, row``: each record under its identifier, name, provider, level, and words."""
    entry = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("value"))
    text = F.concat_ws(" ", "short_name", "entry_title", "abstract")
    listed = F.concat(
        F.array(entry("concept_id", F.col("concept_id")), entry("short_name", F.col("short_name")),
                entry("provider", F.col("provider_id")), entry("level", F.col("processing_level")), entry("all", F.lit(""))),
        F.transform(_words(text), lambda x: entry("word", x)),
    )
    return records.select("row", F.explode(listed).alias("k")).select("k.*", "row").where(F.col("value").isNotNull())


def _routes(distinct: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ask, kind, value``: the lists that each search reads; records on them are all that can match.
    ``kind, value, row``: those lists.

    A word of a search may stand inside a word of a record, so its list has the records of all words
    that hold it; those are found once for each distinct word, by their pieces.
    """
    sizes = cut_lineage(index.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("size")), "index_sizes")
    words = distinct.select(F.explode(_words(F.col("keyword"))).alias("word")).distinct()
    vocabulary = sizes.where("kind = 'word'").select(F.col("value").alias("name"), "size")
    held = contains_join(words.select("word", F.array("word").alias("parts")), vocabulary, "parts", "name")
    held = cut_lineage(held.select("word", F.col("match_name").alias("value"), F.col("match_size").alias("size")), "word_hits")
    reach = held.groupBy("word").agg(F.sum("size").alias("size"))

    def exact(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    options = F.filter(
        F.concat(
            F.array(*[exact(k, F.col(k)) for k in ("concept_id", "short_name", "provider")], exact("level", F.when(F.col("levels").isNotNull(), F.lit(""))),
                    exact("all", F.lit(""))),
            F.transform(F.coalesce(_words(F.col("keyword")), F.array().cast("array<string>")), lambda x: exact("word", x)),
        ),
        lambda o: o["value"].isNotNull(),
    )
    asked = distinct.select("ask", "levels", F.explode(options).alias("o")).select("ask", "levels", "o.*")
    plain = asked.where("kind not in ('word', 'level')").join(sizes, ["kind", "value"], "left").select("ask", "kind", "value", "size")
    level = (asked.where("kind = 'level'").select("ask", F.explode_outer("levels").alias("value"))
             .join(sizes.where("kind = 'level'").select("value", "size"), "value", "left")
             .groupBy("ask").agg(F.sum("size").alias("size")).select("ask", F.lit("level").alias("kind"), F.lit("").alias("value"), "size"))
    word = asked.where("kind = 'word'").join(reach, F.col("value") == F.col("word"), "left").select("ask", "kind", "value", "size")
    best = cut_lineage(
        plain.unionByName(level).unionByName(word).groupBy("ask")
        .agg(F.min_by(F.struct("kind", "value"), F.struct(F.coalesce("size", F.lit(0)), "kind", "value")).alias("b")).select("ask", "b.*"), "routes")
    by_level = best.where("kind = 'level'").select("ask").join(distinct.select("ask", F.explode("levels").alias("value")), "ask").select(
        "ask", F.lit("level").alias("kind"), "value")
    routes = cut_lineage(best.where("kind <> 'level'").unionByName(by_level), "read_lists")
    read = routes.select("kind", F.col("value").alias("list")).distinct()
    words_read = read.where("kind = 'word'").join(held, F.col("list") == F.col("word")).select("kind", "list", "value")
    under = read.where("kind <> 'word'").withColumn("value", F.col("list")).unionByName(words_read)
    # A record may hold several words of one list.
    return routes, index.join(under, ["kind", "value"]).select("kind", F.col("list").alias("value"), "row").distinct()


def _lon_overlap(w: Column, e: Column, gw: Column, ge: Column) -> Column:
    """Closed longitude intervals meet; either may cross the antimeridian."""
    inside = lambda a, b: F.when(gw <= ge, (gw <= b) & (ge >= a)).otherwise((gw <= b) | (ge >= a))
    return F.when(w <= e, inside(w, e)).otherwise(inside(w, F.lit(180.0)) | inside(F.lit(-180.0), e))


def search_catalog(collections: DataFrame, searches: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``search_id, rank, concept_id, short_name, entry_title``: what each search finds, by ``concept_id``.

    ``searches``: ``search_id`` and any of ``SEARCH_COLUMNS`` and ``limit`` (10 by default, 50 at
    most); other columns are dropped. Every word of ``keyword`` must be in the record's names or
    abstract, also inside a word; null filters ask nothing; all filters must hold, times and boxes
    by overlap. A search that finds nothing has no row. ``collections`` as in ``search_collections``.
    """
    each = _with_columns(searches, SEARCH_COLUMNS, limit)
    # A level list is the same in any order; so is a keyword.
    terms = {"keyword": F.array_join(F.array_sort(_words(F.col("keyword"))), " "), "levels": F.array_sort(F.array_distinct("levels"))}
    each = each.withColumns(terms).withColumn("ask", F.unhex(F.sha2(F.to_json(F.struct(*SEARCH_COLUMNS, "limit")), 256)))
    each = cut_lineage(each, "searches")
    distinct = each.drop("search_id").dropDuplicates(["ask"])
    records = cut_lineage(collections.where("concept_id is not null").select(
        F.monotonically_increasing_id().alias("row"), "concept_id", "short_name", "provider_id", "entry_title", "abstract", "processing_level", "time_start", "time_end",
        F.col("has_granules").alias("found_granules"), *[F.col(c).alias(f"g{c}") for c in "wsen"]), "records")
    index = cut_lineage(_index(records), "index")
    routes, lists = _routes(distinct, index)
    left = cut_lineage(routes.join(distinct, "ask"), "ways")
    lists = cut_lineage(lists.join(records.drop("entry_title", "abstract"), "row"), "lists")
    texts = records.select("concept_id", "row", "entry_title", "abstract")
    cuts, found = _cuts(records.select("concept_id")), []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):

        def block(of: DataFrame, low: str | None = low, high: str | None = high) -> DataFrame:
            of = of if low is None else of.where(F.col("concept_id") > low)
            return of if high is None else of.where(F.col("concept_id") <= high)

        found.append(cut_lineage(_hits(left, block(lists), block(texts).drop("concept_id")), "round"))
        so_far = reduce(DataFrame.unionByName, found)
        if high is None:
            break
        done = so_far.groupBy("ask").agg(F.count(F.lit(1)).alias("n"), F.any_value("limit").alias("limit")).where("n >= limit").select("ask")
        left = cut_lineage(left.join(done, "ask", "left_anti"), "ways")
    best = _top(so_far, "ask", [F.col("concept_id")])
    return each.select("search_id", "ask").join(best, "ask").select("search_id", F.col("rank").cast("long").alias("rank"), "concept_id", "short_name", "entry_title")


def _cuts(ids: DataFrame) -> list[str]:
    """Identifiers that part the records into rounds.

    The first are counted exactly. Those beyond are found by counting a share of the identifiers, at
    most about as many as the first, so few come to the driver; wherever they fall, all records are met.
    """
    most = _ROUNDS[-1]
    front = [r[0] for r in ids.orderBy("concept_id").limit(most).collect()]
    cuts = [front[n - 1] for n in _ROUNDS if n <= len(front)]
    total = ids.count()
    if total <= most * _FARTHER:
        return cuts
    share = -(-total // most)
    some = [r[0] for r in ids.where(F.col("concept_id") > front[-1]).where(F.pmod(F.xxhash64("concept_id"), F.lit(share)) == 0).orderBy("concept_id").collect()]
    reach = most * _FARTHER
    while (at := (reach - most) // share) < len(some):
        cuts.append(some[at])
        reach *= _FARTHER
    return cuts


def _hits(routes: DataFrame, index: DataFrame, texts: DataFrame) -> DataFrame:
    """What searches find on their lists in a part of the records: their first rows, with ``limit``."""
    c = F.col
    asks = lambda name, test: c(name).isNull() | test
    # Lists grow from round to round and the searches become fewer, so the searches are the side that is held.
    met = index.withColumnsRenamed({"concept_id": "found_id", "short_name": "found_name"}).join(routes, ["kind", "value"]).where(
        asks("concept_id", c("found_id") == c("concept_id")) & asks("short_name", c("found_name") == c("short_name"))
        & asks("provider", c("provider_id") == c("provider")) & asks("levels", F.array_contains("levels", c("processing_level")))
        & asks("has_granules", c("found_granules") == c("has_granules"))
        & asks("t1", c("time_start") <= c("t1")) & asks("t0", c("time_end") >= c("t0"))
        & asks("w", _lon_overlap(c("w"), c("e"), c("gw"), c("ge")) & (c("gs") <= c("n")) & (c("gn") >= c("s")))
    ).select("ask", "limit", "keyword", "row", "found_id", "found_name")
    text = F.lower(F.concat_ws(" ", "found_name", "entry_title", "abstract"))
    hit = met.join(texts, "row").where(asks("keyword", F.forall(_words(c("keyword")), lambda x: F.contains(text, x))))
    return _top(hit, "ask", [c("found_id")]).select("ask", "limit", c("found_id").alias("concept_id"), c("found_name").alias("short_name"), "entry_title")


def search_granules_in_bulk(granules: DataFrame, searches: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Granules of each search with ``request_id`` and ``rank``, in the order that its row names.

    ``searches``: ``request_id, collection_id`` and any of ``GRANULE_SEARCH_COLUMNS`` and
    ``limit`` (10 by default, 50 at most). Granules are read once for all searches and meet those
    of their collection, tile and time; a null filter asks nothing. ``sort_key`` is one of
    ``SORT_COLUMNS``, with ``-`` in front for falling order; nulls stand first when rising and
    last when falling. Equal keys, and rows without a key, stand by ``(time_start, granule_ur)``;
    an unknown key counts as none.
    """
    each = _with_columns(searches, GRANULE_SEARCH_COLUMNS, limit)
    also = ("cloud_min", "cloud_max", "wanted_flag", "sort_key", "limit")
    each = each.withColumn("wanted_flag", F.lower("day_night_flag")).select("request_id", *AREA, *also)
    c = F.col
    order = []
    for name in SORT_COLUMNS:  # of all these only the one that the row names differs within a search
        order += [F.when(c("sort_key") == name, c(name)).asc(), F.when(c("sort_key") == f"-{name}", c(name)).desc()]

    def answer(asked: DataFrame) -> DataFrame:
        met = overlap_join(asked, granules, also).where(
            (c("cloud_min").isNull() | (c("cloud_cover") >= c("cloud_min"))) & (c("cloud_max").isNull() | (c("cloud_cover") <= c("cloud_max")))
            & (c("wanted_flag").isNull() | (F.lower("day_night_flag") == c("wanted_flag"))))
        return _top(met, "request_id", [*order, c("time_start"), c("granule_ur")]).withColumn("rank", c("rank").cast("long")).drop(*also)

    return once_each(each, answer, (*AREA, *also))

"""Secret scans with an incremental ledger of blobs, on built-in expressions only.

A text version is a blob, named by the SHA-256 of its bytes; a path is the id it is stored
under. The ledger has a row per blob with the rule versions it was scanned for and what they
found. A scan adds only pairs of blob and rule version that the ledger lacks, and findings are
joined back to every path of the blob.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.llm.spans import Pattern, counted, joined, spans_of
from graticule.llm.tables import stored

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""


def _contains(*parts: str) -> object:
    def hint(text: Column) -> Column:
        out = F.lit(False)
        for part in parts:
            out = out | F.contains(text, F.lit(part))
        return out

    return hint


#: Base rules. A hexadecimal or access match is a longest run, so its length is in the pattern.
BASE = (
    Pattern("assign", _ASSIGN, lambda v: F.length(F.regexp_extract(v, _ASSIGN, 1)) >= 8, lambda t: F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))),
    Pattern("access", r"AKIA[A-Z0-9]{12,}+", None, _contains("AKIA")),
    Pattern("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+"),
)
#: Rules of this method beside the base: key headers, signed web tokens, provider tokens.
ADDED = (
    Pattern("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", None, _contains("PRIVATE KEY-----")),
    Pattern("web_token", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", None, _contains("eyJ")),
    Pattern("provider_token", r"(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+)", None, _contains("gh", "xox", "sk_live_")),
)
#: The version of each rule; raise it when the pattern changes, and blobs are scanned anew for it.
VERSIONS = {p.kind: 1 for p in (*BASE, *ADDED)}
KINDS = tuple(VERSIONS)

LEDGER = "blob string, scanned array<string>, spans array<struct<start:bigint,end:bigint,kind:string,value:string>>"


def _blob(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text",
         versions: dict[str, int] | None = None) -> DataFrame:
    """The rows that the ledger lacks: ``blob, scanned, spans`` for unseen blobs and rule versions.

    ``scanned`` has ``rule@version`` of what was scanned in this run; a blob without findings has
    a row with no spans, so it is not scanned again. ``versions`` (rule name to version) picks the
    rules; all by default. Equal texts are one blob whatever their number: they are reduced
    before the shuffle. A null text is the empty blob.
    """
    versions = VERSIONS if versions is None else versions
    rules = {f"{p.kind}@{versions[p.kind]}": p for p in (*BASE, *ADDED) if p.kind in versions}
    blobs = _texts(docs, id_col, text_col).groupBy(_blob(F.col("text")).alias("blob")).agg(F.first("text").alias("text"))
    wanted = F.array(*[F.lit(r) for r in rules]).cast("array<string>")
    if ledger is None:
        pending = blobs.withColumn("scanned", wanted)
    else:
        seen = ledger.select("blob", F.explode("scanned").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        pending = (blobs.join(seen, "blob", "left")
                   .withColumn("scanned", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
                   .filter(F.size("scanned") > 0))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,kind:string,value:string>>")
    found = [F.when(F.array_contains("scanned", r), spans_of(F.col("text"), p)).otherwise(nothing) for r, p in rules.items()]
    return pending.select("blob", "scanned", F.concat(*found).alias("spans"))


def by_path(docs: DataFrame, ledger: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            versions: dict[str, int] | None = None) -> DataFrame:
    """``doc_id, blob, spans`` of each row of ``docs``: what the ledger has for its text.

    Only findings of the current rule versions count. Many paths of one blob meet one ledger row.
    """
    versions = VERSIONS if versions is None else versions
    current = F.array(*[F.lit(f"{k}@{v}") for k, v in versions.items()]).cast("array<string>")
    latest = ledger.withColumn("scanned", F.array_intersect("scanned", current)).select(
        "blob", F.filter("spans", lambda s: F.exists("scanned", lambda r: F.startswith(r, F.concat(s["kind"], F.lit("@"))))).alias("spans"))
    one = latest.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    paths = _texts(docs, id_col, text_col).select("doc_id", _blob(F.col("text")).alias("blob"))
    return paths.join(one, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint,kind:string,value:string>>")).alias("spans"))


def secrets(docs: DataFrame, ledger: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(digest of each row, ledger after this scan).

    The digest is ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``. Spans of one kind
    never overlap; those of several kinds may. Null texts count as empty, ids may be null or
    repeat, extra columns are not read, and an empty table gives an empty digest and adds nothing.
    """
    new = stored(scan(docs, ledger, id_col=id_col, text_col=text_col), "ledger")
    after = new if ledger is None else ledger.select("blob", "scanned", "spans").union(new)
    return digest(by_path(docs, after, id_col=id_col, text_col=text_col)), after


def digest(paths: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin([p.kind for p in BASE]))
    return paths.select("doc_id", *[counted(F.col("spans"), p.kind).alias(f"n_{p.kind}") for p in BASE],
                        F.sha2(joined(base, KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))

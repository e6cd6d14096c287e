"""Text columns: names, URLs, dates, states, and text forms of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media type by file suffix.
SUFFIX_MEDIA_TYPES = {
    ".nc": "application/netcdf4",
    ".nc4": "application/netcdf4",
    ".h5": "application/netcdf4",
    ".hdf5": "application/netcdf4",
}
DEFAULT_MEDIA_TYPE = "application/octet-stream"

# Accepted output-format names → canonical media type.
FORMAT_ALIASES = {
    "zarr": "application/zarr",
    "application/zarr": "application/zarr",
    "parquet": "application/x-parquet",
    "application/x-parquet": "application/x-parquet",
    "application/parquet": "application/x-parquet",
    "csv": "text/csv",
    "text/csv": "text/csv",
    "netcdf": "application/x-netcdf",
    "netcdf4": "application/x-netcdf",
    "application/netcdf4": "application/x-netcdf",
    "application/x-netcdf": "application/x-netcdf",
    "application/x-netcdf4": "application/x-netcdf",
}

# Handle kinds, which are also the handle prefixes.
HANDLE_KINDS = ("dataset", "aoi", "query", "obs", "cube", "preview", "job")

# Remote status words → job state, one table per provider.
SERVICE_STATES = {
    "accepted": "submitted",
    "running": "running",
    "running_with_errors": "running",
    "paused": "running",
    "previewing": "running",
    "successful": "ready",
    "complete_with_errors": "ready",
    "failed": "failed",
    "canceled": "cancelled",
}
POINT_STATES = {
    "pending": "submitted",
    "queued": "submitted",
    "processing": "running",
    "done": "ready",
    "error": "failed",
    "expired": "expired",
    "deleted": "cancelled",
}


def literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def qualified_name(name: Column) -> Column:
    """Variable name with exactly one leading slash added when it has none."""
    return F.when(F.startswith(name, F.lit("/")), name).otherwise(F.concat(F.lit("/"), name))


def leaf_name(name: Column) -> Column:
    """Last path segment, lower-case."""
    return F.lower(F.substring_index(name, "/", -1))


def layer_key(name: Column) -> Column:
    """Comparable form of a layer or variable name."""
    return F.replace(F.lower(F.ltrim(name, F.lit("_"))), F.lit(" "), F.lit("_"))


def percent_encode(text: Column) -> Column:
    """RFC 3986 percent-encoding with no character kept safe beyond the unreserved."""
    form = F.url_encode(text)
    form = F.replace(form, F.lit("+"), F.lit("%20"))
    form = F.replace(form, F.lit("*"), F.lit("%2A"))
    return F.replace(form, F.lit("%7E"), F.lit("~"))


def form_encode(text: Column) -> Column:
    """Query-string encoding: as :func:`percent_encode`, with ``+`` for a space."""
    form = F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))
    return F.replace(form, F.lit("%7E"), F.lit("~"))


def plain_number(value: Column) -> Column:
    """Shortest decimal text of a double, exponent form only below 1e-4 or from 1e16.

    Spark writes exponents from 1e-3 down and from 1e7 up; keys and URLs that must match
    text made elsewhere need the longer plain range.
    """
    text = value.cast("string")
    exponent = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    tail = F.concat(
        F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    plain = F.regexp_replace(value.cast("decimal(38,19)").cast("string"), r"0+$", "")
    plain = F.regexp_replace(plain, r"\.$", ".0")
    return (
        F.when(~F.contains(text, F.lit("E")), text)
        .when((exponent >= -4) & (exponent < 16), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), tail))
    )


def start_date(time_range: Column) -> Column:
    """Date part of the start of a ``start/end`` text; null for null or empty text."""
    start = F.trim(F.substring_index(time_range, "/", 1))
    return F.when(time_range != "", F.substring_index(start, "T", 1))


def us_date(instant: Column) -> Column:
    """``MM-DD-YYYY``."""
    return F.date_format(instant, "MM-dd-yyyy")


def access_url(related_urls: Column) -> Column:
    """First related URL that is a subsetting endpoint, without a trailing ``.html``.

    ``related_urls`` is ``array<struct<URL, Type, Subtype>>``. An entry counts when its
    subtype or its URL names the protocol, in any case.
    """
    first = F.try_element_at(
        F.filter(
            related_urls,
            lambda u: F.contains(F.upper(F.coalesce(u["Subtype"], F.lit(""))), F.lit("OPENDAP"))
            | F.contains(F.lower(F.coalesce(u["URL"], F.lit(""))), F.lit("opendap")),
        ),
        F.lit(1),
    )
    return F.nullif(F.regexp_replace(first["URL"], r"\.html$", ""), F.lit(""))


def _url_path(url: Column) -> Column:
    """Path of a URL, also for text with no scheme; query and fragment dropped."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")


def file_name_from_url(url: Column) -> Column:
    """File name for a subset response: ``X.dap.nc4`` → ``X.nc4``, never a double suffix."""
    last = F.substring_index(_url_path(url), "/", -1)
    stem = F.regexp_replace(last, r"\.dap\.nc4$", "")
    named = F.when(F.endswith(stem, F.lit(".nc4")), stem).otherwise(F.concat(stem, F.lit(".nc4")))
    return (
        F.when(F.endswith(last, F.lit(".dap.nc4")), named)
        .when(last == "", "subset.nc4")
        .otherwise(last)
    )


def job_id_from_url(url: Column) -> Column:
    """Last non-empty path segment of a status URL; null when there is none."""
    path = F.regexp_replace(_url_path(url), r"/+$", "")
    return F.nullif(F.substring_index(path, "/", -1), F.lit(""))


def media_type_of(file_name: Column) -> Column:
    """Media type by file suffix, case-insensitive."""
    suffix = F.lower(F.regexp_extract(file_name, r"(\.[^./\\]+)$", 1))
    return F.coalesce(
        F.try_element_at(literal_map(SUFFIX_MEDIA_TYPES), suffix), F.lit(DEFAULT_MEDIA_TYPE)
    )


def canonical_format(name: Column) -> Column:
    """Output-format alias → media type; null when unknown."""
    return F.try_element_at(literal_map(FORMAT_ALIASES), F.lower(F.trim(name)))


def handle_kind(handle: Column) -> Column:
    """Kind named by a handle's prefix; null for a missing or unknown prefix."""
    prefix = F.substring_index(handle, "_", 1)
    return F.when(F.contains(handle, F.lit("_")) & prefix.isin(*HANDLE_KINDS), prefix)


def job_state_of(status: Column, table: dict[str, str]) -> Column:
    """Remote status word → job state; words not listed count as running."""
    return F.coalesce(
        F.try_element_at(literal_map(table), F.lower(status)), F.lit("running")
    )

"""Column functions on file names, object keys and object URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orthoflow import fixed_values as V

VIRTUAL_HOST = r"^(.+)\.s3[.\-a-z0-9]*\.amazonaws\.com$"
PATH_HOST = r"^s3[.\-a-z0-9]*\.amazonaws\.com$"
URL_PARTS = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?(/[^?#]*)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def extension(name: Column | str) -> Column:
    """Lower-case extension without the dot, or an empty string."""
    return F.lower(F.regexp_extract(F.trim(_col(name)), r"\.([^./\\]*)$", 1))


def supported_format(name: Column | str, formats: tuple[str, ...] = V.CHECKED_FORMATS) -> Column:
    return extension(name).isin(*formats)


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), URL_PARTS, 2)


def file_stem(name: Column | str) -> Column:
    name = _col(name)
    return F.when(F.rlike(name, F.lit(r"^.+\.[^.]+$")), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def revision_keys(source_key: Column | str) -> Column:
    """Struct of the keys of the revised document and of its error report.

    The folder stays; the first ``documento`` of the name becomes ``rev``, other names get
    the prefix ``rev_``.  An empty key is an error.
    """
    key = F.regexp_replace(F.trim(F.coalesce(_col(source_key), F.lit(""))), "^/+", "")
    key = F.regexp_replace(F.regexp_replace(key, "/{2,}", "/"), "/$", "")
    key = F.when(F.length(key) > 0, key).otherwise(F.raise_error(F.lit("the source key is empty")))
    folder = F.regexp_extract(key, r"^(.*/)[^/]*$", 1)
    name = F.regexp_extract(key, r"([^/]*)$", 1)
    revised = F.when(
        F.contains(name, F.lit("documento")), F.regexp_replace(name, "^(.*?)documento", "$1rev")
    ).otherwise(F.concat(F.lit("rev_"), name))
    return F.struct(
        F.concat(folder, revised).alias("correction_key"),
        F.concat(folder, file_stem(revised), F.lit("_errores.json")).alias("json_key"),
        revised.alias("correction_basename"),
        name.alias("original_basename"),
    )


def corrected_name(name: Column | str) -> Column:
    """Name of a corrected copy: ``stem_corregido.ext``."""
    name = _col(name)
    return F.concat(file_stem(name), F.lit("_corregido"), F.substring(name, F.length(file_stem(name)) + 1, F.length(name)))


def _no_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def parse_object_url(url: Column | str) -> Column:
    """Struct (bucket, key) of an ``s3://`` URI, a virtual-host URL or a path-style URL, else null."""
    url = F.trim(_col(url))
    is_uri = F.rlike(url, F.lit("(?i)^s3://[^/]*/"))
    host = F.lower(F.regexp_extract(url, URL_PARTS, 1))
    path = F.regexp_replace(F.regexp_extract(url, URL_PARTS, 2), "^/+", "")
    is_virtual = F.rlike(host, F.lit(VIRTUAL_HOST))
    is_path = F.rlike(host, F.lit(PATH_HOST)) & F.contains(path, F.lit("/"))
    bucket = (
        F.when(is_uri, F.regexp_extract(url, r"(?i)^s3://([^/]*)/", 1))
        .when(is_virtual, F.regexp_extract(host, VIRTUAL_HOST, 1))
        .when(is_path, F.regexp_extract(path, "^([^/]*)/", 1))
    )
    key = (
        F.when(is_uri, F.regexp_extract(url, r"(?i)^s3://[^/]*/+(.*)$", 1))
        .when(is_virtual, path)
        .when(is_path, F.regexp_extract(path, "^[^/]*/(.*)$", 1))
    )
    return F.when(bucket.isNotNull(), F.struct(bucket.alias("bucket"), key.alias("key")))


def object_uri_to_https(uri: Column | str, region: str) -> Column:
    """HTTPS form of an object URI; HTTP(S) passes through; anything else gives an empty string."""
    uri = F.trim(F.coalesce(_col(uri), F.lit("")))
    parts = parse_object_url(uri)
    return (
        F.when(F.rlike(uri, F.lit("(?i)^https?://")), uri)
        .when(
            parts.isNotNull(),
            F.concat(F.lit("https://"), parts["bucket"], F.lit(f".s3.{region}.amazonaws.com/"), parts["key"]),
        )
        .otherwise(F.lit(""))
    )

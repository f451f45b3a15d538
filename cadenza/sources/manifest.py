"""M3U8 playlists as rows, parsed with SQL functions: split into lines, windows carry what is in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions.crypto import implicit_iv


def attributes(text: Column) -> Column:
    """KEY=value pairs of an attribute list; quoted values keep their commas and lose their quotes."""
    pattern = F.lit(r'([A-Z0-9-]+)=("[^"]*"|[^",]*)')
    keys, values = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    return F.map_from_entries(F.arrays_zip(F.transform(keys, lambda k: k).alias("k"), F.transform(values, lambda v: F.regexp_replace(v, '^"|"$', "")).alias("v")))


def lines(playlists: DataFrame, text: str = "text") -> DataFrame:
    """(asset_id, line_no, line): without byte order mark, line ends and empty lines; must begin with #EXTM3U."""
    clean = F.regexp_replace(F.col(text), "^﻿", "")
    ok = F.when(F.trim(F.get(F.split(clean, "\r\n|\n|\r"), F.lit(0))).startswith("#EXTM3U"), clean).otherwise(F.raise_error(F.lit("not an M3U8 playlist")).cast("string"))
    rows = playlists.select("asset_id", F.posexplode(F.split(ok, "\r\n|\n|\r")).alias("line_no", "line"))
    return rows.withColumn("line", F.trim("line")).where("line != ''")


def _tag(name: str) -> Column:
    return F.when(F.col("line").startswith(f"#{name}:"), F.substr("line", F.lit(len(name) + 3)))


def _carried(value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy("asset_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))


def _uri_rows(rows: DataFrame, opener: str) -> DataFrame:
    """Rows of URIs with the last `opener` tag since the URI before."""
    is_uri = ~F.col("line").startswith("#")
    before = Window.partitionBy("asset_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    block = F.coalesce(F.sum(F.when(is_uri, 1).otherwise(0)).over(before), F.lit(0))
    rows = rows.withColumn("_block", block).withColumn("_uri", is_uri)
    own = Window.partitionBy("asset_id", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("_open", F.last(_tag(opener), ignorenulls=True).over(own))


def variants(playlists: DataFrame, text: str = "text") -> DataFrame:
    """A row per variant of a master playlist; URIs without #EXT-X-STREAM-INF are skipped."""
    rows = _uri_rows(lines(playlists, text), "EXT-X-STREAM-INF").where("_uri and _open is not null").withColumn("_a", attributes(F.col("_open")))
    at = lambda k: F.try_element_at("_a", F.lit(k))
    idx = (F.row_number().over(Window.partitionBy("asset_id").orderBy("line_no")) - 1).cast("bigint")
    size = F.split(at("RESOLUTION"), "x")
    return rows.select(
        "asset_id", idx.alias("idx"), F.col("line").alias("uri"), at("BANDWIDTH").cast("bigint").alias("bandwidth"), at("AVERAGE-BANDWIDTH").cast("bigint").alias("avg_bandwidth"),
        F.get(size, F.lit(0)).cast("int").alias("width"), F.get(size, F.lit(1)).cast("int").alias("height"), at("CODECS").alias("codecs"), at("FRAME-RATE").cast("double").alias("frame_rate"),
    )


def segments(playlists: DataFrame, text: str = "text") -> DataFrame:
    """A row per segment of a playlist of segments with the key, map and sequence in force; orphan URIs are skipped.

    A byte range without offset begins at 0; METHOD=NONE clears the key; without an explicit IV the sequence
    number is it. `end_list` tells a finished playlist from a live one."""
    rows = _uri_rows(lines(playlists, text), "EXTINF")
    own = Window.partitionBy("asset_id", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = Window.partitionBy("asset_id")
    rows = rows.withColumns(
        {
            "_key": _carried(_tag("EXT-X-KEY")),
            "_map": _carried(_tag("EXT-X-MAP")),
            "_range": F.last(_tag("EXT-X-BYTERANGE"), ignorenulls=True).over(own),
            "discontinuity": F.max((F.col("line") == "#EXT-X-DISCONTINUITY").cast("int")).over(own) == 1,
            "_first": F.coalesce(F.max(_tag("EXT-X-MEDIA-SEQUENCE").cast("bigint")).over(whole), F.lit(0)),
            "end_list": F.max((F.col("line") == "#EXT-X-ENDLIST").cast("int")).over(whole) == 1,
            "target_duration": F.max(_tag("EXT-X-TARGETDURATION").cast("double")).over(whole),
        }
    ).where("_uri and _open is not null")
    idx = (F.row_number().over(Window.partitionBy("asset_id").orderBy("line_no")) - 1).cast("bigint")
    rows = rows.withColumn("idx", idx).withColumns({"_k": attributes(F.col("_key")), "_m": attributes(F.col("_map")), "sequence": F.col("_first") + F.col("idx")})
    k = lambda name: F.try_element_at("_k", F.lit(name))
    iv = F.coalesce(F.unhex(F.lpad(F.regexp_replace(k("IV"), "^0[xX]", ""), 32, "0")), implicit_iv(F.col("sequence")))
    key = F.when(k("METHOD") != "NONE", F.struct(k("METHOD").alias("method"), k("URI").alias("uri"), iv.alias("iv")))
    parts = F.split("_range", "@")
    byterange = F.when(F.col("_range").isNotNull(), F.struct(F.get(parts, F.lit(0)).cast("bigint").alias("length"), F.coalesce(F.get(parts, F.lit(1)).cast("bigint"), F.lit(0)).alias("offset")))
    duration = F.regexp_extract("_open", r"^\s*([0-9.]+)", 1).cast("double")
    return rows.select("asset_id", "idx", F.col("line").alias("uri"), duration.alias("duration_sec"), key.alias("key"), byterange.alias("byterange"), F.try_element_at("_m", F.lit("URI")).alias("map_uri"), "discontinuity", "sequence", "end_list", "target_duration")


def is_master(playlists: DataFrame, text: str = "text") -> DataFrame:
    return lines(playlists, text).groupBy("asset_id").agg((F.max(F.col("line").startswith("#EXT-X-STREAM-INF:").cast("int")) == 1).alias("is_master"))


def resolve_uri(base: Column, uri: Column) -> Column:
    """Absolute URIs as they are, rooted paths on the base's host, others beside the base file."""
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^(.*/)", 1)
    return F.when(uri.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), uri).when(uri.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), uri)).when(uri.startswith("/"), F.concat(host, uri)).otherwise(F.concat(folder, uri))


def assemble(parts: DataFrame, bodies: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """One asset's bytes from its finished playlist: segments by URI, decrypted, cut, joined in order.

    `bodies` is (uri, content), `keys` (uri, key) of 16 bytes. A live or incomplete playlist raises."""
    from ..functions.crypto import hls_aes128

    rows = parts.withColumn("idx", F.when(F.col("end_list"), F.col("idx")).otherwise(F.raise_error(F.lit("live playlists can't be assembled")).cast("bigint")))
    rows = rows.join(bodies, "uri", "left").withColumn("content", F.coalesce("content", F.raise_error(F.concat(F.lit("no segment "), F.col("uri"))).cast("binary")))
    rows = rows.withColumn("content", F.when(F.col("byterange").isNotNull(), F.expr("substring(content, cast(byterange.offset + 1 as int), cast(byterange.length as int))")).otherwise(F.col("content")))
    if keys is not None:
        rows = rows.withColumn("_u", F.col("key.uri")).join(keys.select(F.col("uri").alias("_u"), F.col("key").alias("_k")), "_u", "left")
        rows = rows.withColumn("content", F.when(F.col("key").isNotNull(), hls_aes128(F.col("content"), F.col("_k"), F.col("key.iv"))).otherwise(F.col("content")))
    else:
        rows = rows.withColumn("content", F.when(F.col("key").isNull(), F.col("content")).otherwise(F.raise_error(F.lit("no key for an encrypted segment")).cast("binary")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "content"))), lambda x: F.hex(x["content"]))
    return rows.groupBy("asset_id").agg(F.unhex(F.array_join(ordered, "")).alias("content"))


def check_playlist(text: str) -> None:
    if not text.lstrip("﻿").startswith("#EXTM3U"):
        raise InputError.bad("not an M3U8 playlist")

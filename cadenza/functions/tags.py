"""Tag maps: normalising keys, merging, and the Vorbis names. Map expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a key, after lower-casing and blanks to underscores, and its public name.
PUBLIC = {
    "album": "album", "albumartist": "albumArtist", "album_artist": "albumArtist", "artist": "artist", "comment": "comment", "comments": "comment", "date": "date",
    "description": "description", "genre": "genre", "title": "title", "track": "trackNumber", "tracknumber": "trackNumber", "track_number": "trackNumber",
}
#: Public names that have a Vorbis name of their own.
VORBIS = ("album", "albumArtist", "artist", "comment", "date", "description", "genre", "title", "trackNumber")


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def public_key(key: Column) -> Column:
    compact = F.regexp_replace(F.trim(key), r"[\s-]+", "_")
    return F.coalesce(F.try_element_at(_table(PUBLIC), F.lower(compact)), compact)


def normalize_tags(tags: Column) -> Column:
    """Entries with normal keys, sorted by key; empty keys go, a NUL raises. Of equal keys the last stays."""
    bad = F.exists(F.map_entries(tags), lambda e: F.contains(e["key"], F.lit("\0")) | F.contains(F.coalesce(e["value"], F.lit("")), F.lit("\0")))
    named = F.filter(F.transform(F.map_entries(tags), lambda e: F.struct(public_key(e["key"]).alias("key"), e["value"].alias("value"))), lambda e: e["key"] != "")
    keys = F.array_sort(F.array_distinct(F.transform(named, lambda e: e["key"])))
    last = lambda k: F.element_at(F.filter(named, lambda e: e["key"] == k), -1)["value"]
    out = F.map_from_arrays(keys, F.transform(keys, last))
    return F.when(bad, F.raise_error(F.lit("tags must not contain NUL")).cast("map<string,string>")).otherwise(out)


def upsert_tags(old: Column, new: Column) -> Column:
    """Old entries that are not replaced, by normal key, and then the new ones, normalised."""
    fresh = normalize_tags(new)
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(fresh, public_key(k)), F.lit(False)))
    return F.map_concat(kept, fresh)


def vorbis_key(key: Column) -> Column:
    clean = F.upper(F.regexp_replace(F.regexp_replace(F.trim(key), r"[\s-]+", "_"), "[^A-Za-z0-9_]", "_"))
    known = F.try_element_at(_table({k: k.upper() for k in VORBIS}), public_key(key))
    return F.coalesce(known, F.when(clean == "", F.lit("TAG")).otherwise(clean))


def from_vorbis_key(key: Column) -> Column:
    upper = F.upper(F.trim(key))
    return F.coalesce(F.try_element_at(_table({k.upper(): k for k in VORBIS}), upper), F.lower(upper))

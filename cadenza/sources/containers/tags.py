"""Tags in files: ID3v2.4, FLAC and Ogg comments, RIFF INFO, AIFF text chunks, CAF info, Matroska, MP4."""

from __future__ import annotations

import struct

from ...errors import CapabilityError, InputError
from . import elementary, flac, matroska, mp4, ogg
from .base import Reader

#: ID3 frames, RIFF INFO and AIFF chunk names of the public tag names.
ID3 = {"title": b"TIT2", "artist": b"TPE1", "album": b"TALB", "albumArtist": b"TPE2", "date": b"TDRC", "genre": b"TCON", "trackNumber": b"TRCK"}
INFO = {"title": b"INAM", "artist": b"IART", "album": b"IPRD", "comment": b"ICMT", "date": b"ICRD", "genre": b"IGNR", "trackNumber": b"ITRK"}
AIFF = {"title": b"NAME", "artist": b"AUTH", "comment": b"ANNO"}


def _check(tags: dict[str, str]) -> dict[str, str]:
    if any("\0" in k or "\0" in v for k, v in tags.items()):
        raise InputError.bad("tags must not contain NUL")
    return {k: v for k, v in tags.items() if k}


def _vorbis(tags: dict[str, str]) -> dict[str, str]:
    import re

    return {re.sub(r"[^A-Za-z0-9_]", "_", k).upper() or "TAG": v for k, v in tags.items()}


def id3(tags: dict[str, str]) -> bytes:
    frames = b""
    for k, v in tags.items():
        body = b"\3" + v.encode() if k in ID3 else b"\3eng\0" + v.encode() if k == "comment" else b"\3" + k.encode() + b"\0" + v.encode()
        n = len(body)
        frames += ID3.get(k, b"COMM" if k == "comment" else b"TXXX") + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + b"\0\0" + body
    n = len(frames)
    return b"ID3\4\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frames


def read_id3(data: bytes) -> dict[str, str]:
    end, at, out = elementary.id3_size(data), 10, {}
    names = {v: k for k, v in ID3.items()}
    while at + 10 <= end and data[at]:
        name, n = data[at : at + 4], data[at + 4 : at + 8]
        size = n[0] << 21 | n[1] << 14 | n[2] << 7 | n[3] if data[3] == 4 else int.from_bytes(n, "big")
        body = data[at + 10 : at + 10 + size]
        code = {0: "latin1", 1: "utf-16", 2: "utf-16-be"}.get(body[0] if body else 3, "utf-8")
        text = body[1:].decode(code, "replace").rstrip("\0")
        if name == b"TXXX":
            k, _, v = text.partition("\0")
            out[k] = v
        elif name == b"COMM":
            out["comment"] = text[3:].partition("\0")[2]
        elif name in names:
            out[names[name]] = text
        at += 10 + size
    return out


def _riff_body(data: bytes, little: bool, drop) -> bytes:
    r, out = Reader(data, 12, what="a chunk file"), b""
    while r.left() >= 8:
        at = r.at
        name, n = r.take(4), r.u(4, little)
        body = r.take(min(n, r.left()))
        r.at = min(r.end, r.at + (n & 1))
        if not drop(name, body):
            piece = data[at : r.at]
            out += piece + b"\0" * (len(piece) & 1)
    return out


def write_tags(data: bytes, container: str, tags: dict[str, str]) -> bytes:
    """The file with exactly these tags, its streams unchanged."""
    tags = _check(tags)
    if container == "mp3":
        return id3(tags) + data[elementary.id3_size(data) :]
    if container == "flac":
        info, at, kept = flac.parse_info(data), 4, []
        while True:
            kind, n = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
            if kind & 0x7F != 4:
                kept.append((kind & 0x7F, data[at + 4 : at + 4 + n]))
            at += 4 + n
            if kind & 0x80:
                break
        kept.insert(1, (4, flac.comment_block(_vorbis(tags))))
        head = b"".join(bytes([k | (0x80 if i == len(kept) - 1 else 0)]) + len(b).to_bytes(3, "big") + b for i, (k, b) in enumerate(kept))
        return b"fLaC" + head + data[info.audio :]
    if container == "ogg":
        m = ogg.movie(data)
        t = m.tracks[0]
        return ogg.write(t, [t.payload(p, data) for p in t.packets], _vorbis(tags))
    if container == "wav":
        body = _riff_body(data, True, lambda n, b: n == b"LIST" and b[:4] == b"INFO")
        known = {k: v for k, v in tags.items() if k in INFO}
        info = b"".join(INFO[k] + struct.pack("<I", len(v.encode()) + 1) + v.encode() + b"\0" + b"\0" * ((len(v.encode()) + 1) & 1) for k, v in known.items())
        body += b"LIST" + struct.pack("<I", 4 + len(info)) + b"INFO" + info if known else b""
        return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body
    if container == "aiff":
        body = _riff_body(data, False, lambda n, b: n in AIFF.values())
        for k, v in tags.items():
            if k in AIFF:
                body += AIFF[k] + struct.pack(">I", len(v.encode())) + v.encode() + b"\0" * (len(v.encode()) & 1)
        return b"FORM" + struct.pack(">I", 4 + len(body)) + data[8:12] + body
    if container == "caf":
        at, out = 8, b""
        strings = b"".join(k.encode() + b"\0" + v.encode() + b"\0" for k, v in tags.items())
        info = b"info" + struct.pack(">qI", 4 + len(strings), len(tags)) + strings
        while at + 12 <= len(data):
            n = struct.unpack(">q", data[at + 4 : at + 12])[0]
            end = len(data) if n < 0 else at + 12 + n
            if data[at : at + 4] != b"info":
                out += (info if data[at : at + 4] == b"data" else b"") + data[at:end]
            at = end
        return data[:8] + out
    if container in ("mkv", "webm", "mp4", "mov"):
        m = (mp4 if container in ("mp4", "mov") else matroska).movie(data)
        payloads = [[t.payload(p, data) for p in t.packets] for t in m.tracks]
        return (mp4 if container in ("mp4", "mov") else matroska).write(m.tracks, payloads, container, tags)
    raise CapabilityError.miss(f"{container} has no tags", {"op": "tags", "container": container})


def read_tags(data: bytes, container: str) -> dict[str, str]:
    if container == "mp3":
        return read_id3(data)
    if container == "flac":
        return flac.parse_info(data).comments
    if container == "ogg":
        return ogg.movie(data).tags
    if container in ("mkv", "webm"):
        return matroska.movie(data).tags
    if container in ("mp4", "mov"):
        return mp4.movie(data).tags
    out: dict[str, str] = {}
    if container == "wav":
        names = {v: k for k, v in INFO.items()}

        def take(name: bytes, body: bytes) -> bool:
            if name == b"LIST" and body[:4] == b"INFO":
                at = 4
                while at + 8 <= len(body):
                    n = int.from_bytes(body[at + 4 : at + 8], "little")
                    if body[at : at + 4] in names:
                        out[names[body[at : at + 4]]] = body[at + 8 : at + 8 + n].rstrip(b"\0").decode("utf-8", "replace")
                    at += 8 + n + (n & 1)
            return False

        _riff_body(data, True, take)
    elif container == "aiff":
        names = {v: k for k, v in AIFF.items()}
        _riff_body(data, False, lambda n, b: bool(out.update({names[n]: b.decode("utf-8", "replace")})) if n in names else False)
    elif container == "caf":
        at = 8
        while at + 12 <= len(data):
            n = struct.unpack(">q", data[at + 4 : at + 12])[0]
            if data[at : at + 4] == b"info":
                parts = data[at + 16 : at + 12 + n].split(b"\0")
                out |= {k.decode(): v.decode() for k, v in zip(parts[0:-1:2], parts[1::2], strict=False)}
            at = len(data) if n < 0 else at + 12 + n
    return out

"""Structural checks that any container driver must pass, given one valid file of it."""

from __future__ import annotations

from collections.abc import Callable

from ..errors import EngineError
from ..sources.containers.base import Movie

TRACK_KINDS = ("video", "audio", "other")


def check_container(parse: Callable[[bytes], Movie], data: bytes) -> list[str]:
    """What is wrong with a parser, as texts; empty if nothing."""
    wrong = []
    m = parse(data)
    if not m.tracks:
        wrong.append("no tracks")
    if len({t.track_id for t in m.tracks}) != len(m.tracks):
        wrong.append("track ids repeat")
    for t in m.tracks:
        if t.track_kind not in TRACK_KINDS:
            wrong.append(f"track {t.track_id} has the kind {t.track_kind}")
        decode = [p.pts_us if p.dts_us is None else p.dts_us for p in t.packets]
        if t.track_kind != "other" and any(p.dts_us is not None for p in t.packets) and decode != sorted(decode):
            wrong.append(f"track {t.track_id} isn't in decode order")
        if t.packets and t.track_kind == "video" and not t.packets[0].keyframe:
            wrong.append(f"track {t.track_id} doesn't begin with a keyframe")
        for p in t.packets:
            inside = p.data is not None and len(p.data) == p.size or p.offset is not None and 0 <= p.offset and p.offset + p.size <= len(data)
            if not inside:
                wrong.append(f"a packet of track {t.track_id} lies outside the file")
                break
    for cut in (0, 3, len(data) // 3):
        try:
            parse(data[:cut])
        except EngineError:
            pass
        except Exception as e:
            wrong.append(f"{cut} bytes raise {type(e).__name__}")
    return wrong

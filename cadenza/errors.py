"""Typed errors. Batch jobs carry the code in an `error_code` column instead of failing the job."""

from __future__ import annotations

#: The codes an error may have.
CODES = ("capability-miss", "unsupported-input", "decode-error", "encode-error", "demux-error", "mux-error", "aborted", "driver-incompatible")


class EngineError(Exception):
    """Any error of the engine, with a machine-readable code and optional detail."""

    def __init__(self, code: str, message: str, detail: object = None) -> None:
        if code not in CODES:
            raise ValueError(f"unknown error code {code!r}")
        super().__init__(message)
        self.code, self.detail = code, detail

    def __reduce__(self):
        return type(self), (self.code, self.args[0], self.detail)


class CapabilityError(EngineError):
    """Nothing registered can do this; `detail` has op, tried and perhaps a suggestion."""

    @classmethod
    def miss(cls, message: str, op: object, tried: list[str] | tuple[str, ...] = (), suggestion: str | None = None) -> CapabilityError:
        return cls("capability-miss", message, {"op": op, "tried": list(tried), "suggestion": suggestion})


class InputError(EngineError):
    """The input or an argument is empty, garbled, out of range or of an unknown kind."""

    @classmethod
    def bad(cls, message: str, detail: object = None) -> InputError:
        return cls("unsupported-input", message, detail)

"""Container formats: each module parses bytes to a `Movie` (tracks and packet rows, payload by offset) and, where
the format can be written, builds bytes from tracks with payloads. Plain functions over one file; the
DataFrame side is in `cadenza.sources.files`.
"""

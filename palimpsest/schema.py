"""Explicit schemas of the archive's tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BinaryType()
HEADERS = T.MapType(_S, _S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Where the bytes of a capture lie when they are not inline.
SOURCE = _struct(archive=_S, path=_S, start=_L, length=_L)

CAPTURES = _struct(
    url=_S, ts_ms=_L, status=_I, status_text=_S, mime=_S, digest=_S, record_digest=_S,
    resp_headers=HEADERS, req_headers=HEADERS, method=_S, request_url=_S, request_body=_B,
    referrer=_S, page_id=_S, orig_url=_S, orig_ts_ms=_L, orig_archive=_S, cookie=_S,
    source=SOURCE, payload=_B, seq=_L,
)

PAGES = _struct(id=_S, url=_S, title=_S, ts_ms=_L, state=_I, text=_S, wacz=_S, extra=_S)
PAGE_LISTS = _struct(id=_L, title=_S, desc=_S, show=T.BooleanType(), pages=T.ArrayType(PAGES))
DIGEST_REFS = _struct(digest=_S, refs=_L, size=_L)
PAYLOADS = _struct(digest=_S, payload=_B)
INDEX_BLOCKS = _struct(archive=_S, prefix=_S, filename=_S, offset=_L, length=_L, digest=_S, loaded=T.BooleanType())
ZIP_ENTRIES = _struct(filename=_S, deflate=T.BooleanType(), uncompressed_size=_L, compressed_size=_L, local_entry_offset=_L, offset=_L)
VERIFICATION = _struct(id=_S, expected=_S, matched=T.BooleanType())
COLLECTIONS = _struct(name=_S, type=_S, title=_S, ctime=_L, size=_L, total_size=_L, headers=HEADERS, metadata=T.MapType(_S, _S))

#: Page states: bit flags for finished and needs-sync.
NOT_FINISHED, NEED_LOAD, SYNCED = 0x00, 0x10, 0x11

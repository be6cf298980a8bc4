"""Hashes, digest manifests and signature metadata."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.stats import verify


def name_hash(name: Column) -> Column:
    """An archive's id when it has none: the hash of its name (V4)."""
    return F.concat(F.lit("sha256:"), F.sha2(name, 256))


def payload_hash(payload: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(payload, 256))


def check_manifest(resources: DataFrame, files: DataFrame) -> DataFrame:
    """(id, expected, matched) of a manifest's files by their bytes (V3)."""
    actual = files.select(F.col("path").alias("id"), payload_hash(F.col("payload")).alias("actual"))
    return verify(resources.select(F.col("path").alias("id"), F.col("hash").alias("expected")), actual)


def certificate_fingerprint(pem: str) -> str | None:
    """SHA-256 of the first certificate of a chain."""
    body = pem.partition("-----BEGIN CERTIFICATE-----")[2].partition("-----END CERTIFICATE-----")[0]
    try:
        return hashlib.sha256(base64.b64decode("".join(body.split()), validate=True)).hexdigest() if body else None
    except ValueError:
        return None


def digest_record(text: str, manifest: bytes) -> list[tuple[str, str, bool | None]]:
    """(id, expected, matched) of a signed digest file (V2): hash and fingerprint are
    checked; the signature itself needs an elliptic-curve module and stays null."""
    d = json.loads(text)
    out: list[tuple[str, str, bool | None]] = []
    have = "sha256:" + hashlib.sha256(manifest).hexdigest()
    out.append(("datapackageHash", d.get("hash", ""), d.get("hash") == have))
    signed = d.get("signedData") or {}
    if signed:
        out.append(("signature", signed.get("signature", ""), None))
        if signed.get("hash"):
            out.append(("signedHash", signed["hash"], signed["hash"] == have))
        if signed.get("domainCert"):
            out.append(("certFingerprint", certificate_fingerprint(signed["domainCert"]) or "", None))
    return out

"""Identifiers, digests, paths and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of identifiers; fixed values.
PREFIXES = {"tenant": "ten_", "job": "job_", "upload": "upl_", "webhook": "whs_", "document": "doc_", "observation": "obs_", "table": "tbl_", "memory": "mem_", "chunk": "chk_"}
PATTERNS = {k: f"^{p}[A-Za-z0-9_]{{1,64}}$" for k, p in PREFIXES.items()} | {
    "product": "^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$",
    "idempotency": "^[!-~]{1,128}$",
    "digest": "^sha256:[0-9a-f]{64}$",
    "embedding": "^emb_[a-z0-9](?:[a-z0-9._-]{0,58}[a-z0-9])?$",
    "code": "^[a-z][a-z0-9_]{0,63}$",
    "currency": "^[A-Z]{3}$",
    "language": "^[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})*$",
    "semver": r"^(?:0|[1-9]\d{0,4})\.(?:0|[1-9]\d{0,4})\.(?:0|[1-9]\d{0,4})$",
    "model": "^(?=.{1,64}$)[a-z0-9](?:[a-z0-9._-]*[a-z0-9])?$",
    "license": "^(?! )[A-Za-z0-9.+() -]{1,128}(?<! )$",
    "locale": "^(?=.{2,32}$)[A-Za-z][A-Za-z-]*[A-Za-z]$",
    "tensor": "^[A-Za-z][A-Za-z0-9_]{0,63}$",
}


def valid(kind: str, value: Column) -> Column:
    """Whether an identifier has its form; null counts as not, and so does one with a line end behind it."""
    # A pattern's last sign would also match before a line end.
    return F.coalesce(value.rlike(PATTERNS[kind].removesuffix("$") + r"\z"), F.lit(False))


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def workflow_id(product: Column, tenant: Column, job: Column) -> Column:
    """Scoped identifier: 32 hex digits of the digest of the NUL-separated parts."""
    return F.concat(F.lit("ocr-v1-"), F.substring(F.sha2(F.concat_ws("\0", product, tenant, job), 256), 1, 32))


def point_id(tenant: Column, record: Column, version: Column, embedding: Column) -> Column:
    """A UUID of version 8 from the digest of length-framed parts."""
    framed = [F.lit(b"ocr-memory-point-v1")]
    for v in (tenant, record, version, embedding):
        framed += [F.unhex(F.lpad(F.hex(F.octet_length(v)), 16, "0")), F.encode(v, "UTF-8")]
    h = F.sha2(F.concat(*framed), 256)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def page_path(product: Column, tenant: Column, job: Column, page: Column, attempt: Column) -> Column:
    return F.format_string("products/%s/tenants/%s/pages/%s/%d/attempt-%d.json", product, tenant, job, page, attempt)


def result_path(product: Column, tenant: Column, job: Column, hex_digest: Column) -> Column:
    return F.format_string("products/%s/tenants/%s/results/%s/%s.json", product, tenant, job, hex_digest)


def document_path(product: Column, tenant: Column, hex_digest: Column) -> Column:
    return F.format_string("products/%s/tenants/%s/documents/sha256/%s", product, tenant, hex_digest)


def activity_key(job: Column, page: Column, attempt: Column) -> Column:
    return F.format_string("ocr-job-%s-page-%d-attempt-%d", job, page, attempt)


def activity_id(page: Column) -> Column:
    return F.format_string("ocr-page-%04d", page)


def location(url: Column) -> Column:
    """Provider, bucket and object of a storage address; no scheme means gs."""
    scheme = F.regexp_extract(url, r"^(gs|s3|az)://", 1)
    rest = F.regexp_replace(url, r"^(?:gs|s3|az)://", "")
    return F.struct(F.when(scheme == "", "gs").otherwise(scheme).alias("provider"), F.regexp_extract(rest, r"^([^/]*)", 1).alias("bucket"), F.regexp_extract(rest, r"^[^/]*/(.*)$", 1).alias("object"))


def gtin_valid(digits: Column) -> Column:
    """Whether a string is a GTIN of 8, 12 or 13 digits with the right check digit (weights 3, 1 from the right)."""
    n = F.length(digits)
    marks = F.transform(F.sequence(F.lit(2), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    total = F.aggregate(marks, F.lit(0), lambda a, x: a + x)
    right = F.pmod(10 - total % 10, F.lit(10)) == F.substring(digits, n, F.lit(1)).cast("int")
    return F.when(digits.rlike(r"^(?:\d{8}|\d{12}|\d{13})$"), right).otherwise(False)

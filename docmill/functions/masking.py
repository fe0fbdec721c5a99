"""Masking of columns by policy: redact, hash, obscure or preserve, at any depth, without UDFs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

ORDER = ("preserve", "obscure", "hash", "redact")
#: Field-name patterns that are masked unless a policy says otherwise, in order.
STOCK = [(r"(?i)passw(or)?d|passphrase", "redact"), (r"(?i)secret|private_?key", "redact"), (r"(?i)token|api_?key", "redact"), (r"(?i)ssn|social_?security", "redact"), (r"(?i)credit_?card|card_?number|cvv", "redact"), (r"(?i)e_?mail", "obscure"), (r"(?i)phone|mobile", "obscure"), (r"(?i)address|street|postal", "obscure"), (r"(?i)birth|dob", "redact"), (r"(?i)ip_?addr", "hash"), (r"(?i)user_?name|login", "hash")]


@dataclass(frozen=True)
class Policy:
    """How fields are masked: by exact path first (``a.b``, list items as ``tags[]``), then the first pattern, then the default."""

    fields: dict[str, str] = field(default_factory=dict)
    patterns: list[tuple[str, str]] = field(default_factory=list)
    default: str = "preserve"
    prefix: int = 2
    suffix: int = 2
    replacement: str = "*"
    max_length: int = 0
    secret: str = ""
    exempt: tuple[str, ...] = ("_metadata_", "_id_")
    #: Another scope's policy, whose mask holds where it is the more restrictive.
    both: Policy | None = None

    def of(self, path: str) -> str:
        if path.split(".")[0] in self.exempt:
            return "preserve"
        leaf = path.split(".")[-1].removesuffix("[]")
        if path in self.fields or leaf in self.fields:
            return self.fields.get(path, self.fields.get(leaf, self.default))
        found = next((p for r, p in self.patterns if re.search(r, leaf)), self.default)
        return max(found, self.both.of(path), key=ORDER.index) if self.both else found

    def with_stock(self) -> Policy:
        return replace(self, patterns=[*self.patterns, *STOCK])

    def combined(self, other: Policy) -> Policy:
        """Both policies' scopes: for a field that both name the more restrictive mask holds."""
        both = {k: max(self.of(k), other.of(k), key=ORDER.index) for k in {*self.fields, *other.fields}}
        return replace(self, fields=both, both=other if self.both is None else self.both.combined(other))


def redact(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("***"))


def hmac_sha256(c: Column, secret: str) -> Column:
    """HMAC-SHA256 in hex, from two SHA-256 expressions over padded keys."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), F.encode(c, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def hashed(c: Column, secret: str) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit("[HASH:"), F.substring(hmac_sha256(c.cast("string"), secret), 1, 8), F.lit("]")))


def obscure(c: Column, prefix: int = 2, suffix: int = 2, replacement: str = "*", max_length: int = 0, short: int | None = None) -> Column:
    """First and last characters with the middle replaced; texts of up to ``short`` (prefix + suffix) characters wholly."""
    s, n = c.cast("string"), F.length(c.cast("string"))
    middle = n - prefix - suffix
    if max_length:
        middle = F.least(middle, F.lit(max(0, max_length - prefix - suffix)))
    made = F.concat(F.substring(s, 1, prefix), F.repeat(F.lit(replacement), middle), F.right(s, F.lit(suffix)) if suffix else F.lit(""))
    return F.when(c.isNull(), None).when(n <= (prefix + suffix if short is None else short), F.lit("[OBSCURED]")).otherwise(made)


def masked_column(c: Column, kind: DataType, path: str, policy: Policy) -> Column:
    how = policy.of(path)
    if isinstance(kind, StructType) and how == "preserve":
        inside = F.struct(*[masked_column(c[f.name], f.dataType, f"{path}.{f.name}", policy).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), inside)
    if isinstance(kind, ArrayType) and how == "preserve":
        return F.transform(c, lambda x: masked_column(x, kind.elementType, f"{path}[]", policy))
    if isinstance(kind, MapType) and how == "preserve":
        return F.transform_values(c, lambda _, v: masked_column(v, kind.valueType, f"{path}.*", policy))
    text = c if isinstance(kind, StringType) else F.to_json(c) if isinstance(kind, (StructType, ArrayType, MapType)) else c.cast("string")
    if how == "redact":
        return redact(text)
    if how == "hash":
        return hashed(text, policy.secret)
    if how == "obscure":
        return obscure(text, policy.prefix, policy.suffix, policy.replacement, policy.max_length)
    return c


def masked(df: DataFrame, policy: Policy) -> DataFrame:
    """All columns under the policy, resolved once from the schema."""
    return df.select(*[masked_column(F.col(f"`{f.name}`"), f.dataType, f.name, policy).alias(f.name) for f in df.schema.fields])
